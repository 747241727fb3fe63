"""Stage tables, summaries and JSON files survive a round trip."""

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors

from inkprint.operators import audit
from inkprint.sources import tables


def test_stage_round_trip(spark, tmp_path):
    rows = [(1, "train", "a", "b", 1), (2, "test", "c", None, 0)]
    df = spark.createDataFrame(rows, "pair_id long, split string, text1 string, text2 string, same int")
    tables.write_stage(df, str(tmp_path), "audited")
    back = tables.read_stage(spark, str(tmp_path), "audited").select(*df.columns)
    assert sorted(map(tuple, back.collect())) == rows
    tables.write_summary(df.groupBy("split").count(), str(tmp_path / "summary"))
    assert spark.read.csv(str(tmp_path / "summary"), header=True).count() == 2


def test_splits(spark, tmp_path):
    for split in ("train", "validation", "test"):
        spark.createDataFrame([("a" + split, "b", 1)], "text1 string, text2 string, same int").write.parquet(str(tmp_path / f"authorship_verification_{split}"))
    made = tables.load_splits(spark, str(tmp_path))
    assert {r.split for r in made.collect()} == {"train", "validation", "test"} and made.select("pair_id").distinct().count() == 3


def test_equal_rows_of_splits_are_told_apart(spark, tmp_path):
    for split in ("train", "validation", "test"):
        spark.createDataFrame([("b", "a", 1), ("a", "b", 1), (f"own {split}", "b", 0)], "text1 string, text2 string, same int").repartition(2).write.parquet(str(tmp_path / f"authorship_verification_{split}"))
    made = tables.load_splits(spark, str(tmp_path))
    assert sorted(r.pair_id for r in made.collect()) == list(range(9))
    kept = audit.dedup(made).collect()
    assert sorted(r.split for r in kept if r.same == 1) == ["train"] and len(kept) == 4


def test_vectors_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, {"type": 0, "size": 5, "indices": [1, 4], "values": [2.0, 3.0]})], f"id int, v {tables.VECTOR}")
    assert tables.as_vectors(df, str(tmp_path / "v"), "v").first().v == Vectors.sparse(5, [1, 4], [2.0, 3.0])
    tables.save_arrays(spark.createDataFrame([([1.0, 2.0],)], "x array<double>"), str(tmp_path), "arrays")
    assert tables.load_arrays(spark, str(tmp_path), "arrays").first().x == [1.0, 2.0]


def test_json(tmp_path):
    @dataclass
    class Config:
        a: int = 1

    path = tmp_path / "x" / "c.json"
    tables.save_json({"config": Config(), "n": np.int64(3), "v": np.arange(2), "p": tmp_path}, path)
    assert tables.load_json(path) == json.loads(path.read_text()) == {"config": {"a": 1}, "n": 3, "v": [0, 1], "p": str(tmp_path)}


def test_arrow(spark, tmp_path):
    source, target = str(tmp_path / "a.arrow"), str(tmp_path / "a.parquet")
    table = pa.table({"text1": ["x", "y"], "same": [0, 1]})
    with pa.OSFile(source, "wb") as out, pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    tables.convert_arrow(source, target)
    assert spark.read.parquet(target).count() == 2
