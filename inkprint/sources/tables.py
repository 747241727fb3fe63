"""Readers and writers of stage tables, summaries and small JSON files."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict, is_dataclass
from functools import lru_cache
from pathlib import Path
from typing import Any

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inkprint.operators.audit import SPLITS, union_splits


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="inkprint-")


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; a cluster
    raises, as each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder()


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own for this call in the shared one."""
    return f"{shared_base(spark)}/inkprint/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write into the shared folder and read back: what several later steps read starts from files, as after a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_ids(df: DataFrame, to: str = "row_id") -> DataFrame:
    """Number the rows of a table read from Parquet files 0, 1, ... in the order of files by path and of rows within a file.

    Only one row a file is counted and broadcast; the rows themselves aren't moved.
    """
    marked = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.row_index"))
    sizes = marked.groupBy("_file").agg((F.max("_at") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_file", before.alias("_start"))
    return marked.join(F.broadcast(starts), "_file").withColumn(to, F.col("_start") + F.col("_at")).drop("_file", "_at", "_start")


def load_splits(spark: SparkSession, folder: str, stem: str = "authorship_verification_{}") -> DataFrame:
    """One table from a Parquet table for each split, tagged.

    Unless there is a pair_id, it is made from the row's place in its split, in
    that order, and differs between splits.
    """
    frames = {s: spark.read.parquet(f"{folder}/{stem.format(s)}") for s in SPLITS}
    for n, (split, df) in enumerate(frames.items()):
        if "pair_id" not in df.columns:
            frames[split] = with_row_ids(df, "pair_id").withColumn("pair_id", F.col("pair_id") * len(SPLITS) + n)
    return union_splits(frames)


def convert_arrow(source: str, target: str) -> None:
    """One Arrow stream or file to Parquet, once, where a corpus comes as Arrow."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    with pa.memory_map(source) as raw:
        try:
            reader = pa.ipc.open_stream(raw)
        except pa.ArrowInvalid:
            reader = pa.ipc.open_file(raw).read_all().to_reader()
        with pq.ParquetWriter(target, reader.schema) as out:
            for batch in reader:
                out.write_batch(batch)


def write_stage(df: DataFrame, folder: str, name: str) -> None:
    """A stage table, one directory a split."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/{name}")


def read_stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def write_summary(df: DataFrame, path: str) -> None:
    """A summary of a few rows as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def _plain(value: Any) -> Any:
    if is_dataclass(value) and not isinstance(value, type):
        return asdict(value)
    if isinstance(value, Path):
        return str(value)
    if hasattr(value, "tolist"):
        return value.tolist()
    raise TypeError(f"{type(value).__name__} has no JSON form")


def save_json(value: Any, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, default=_plain, ensure_ascii=False))


def load_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text())


def save_arrays(df: DataFrame, folder: str, name: str) -> None:
    """Rows with array or vector columns, as Parquet; stands for array and matrix files."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_arrays(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


#: How a vector lies in a file: type 0 is sparse, 1 dense.
VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def as_vectors(df: DataFrame, path: str, column: str) -> DataFrame:
    """``df``, with its struct ``column`` in the form VECTOR, written to ``path`` and read back with vectors in that column.

    A vector is this struct where it is stored, so reading it makes vectors
    without a function on rows.
    """
    df.write.mode("overwrite").parquet(path)
    return load_vectors(df.sparkSession, path, column, df.schema)


def load_vectors(spark: SparkSession, path: str, column: str, schema: StructType | None = None) -> DataFrame:
    schema = schema or spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, VectorUDT()) if f.name == column else f for f in schema])).parquet(path)
