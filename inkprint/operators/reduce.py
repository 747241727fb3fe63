"""Truncated SVD of sparse feature families: uncentred, fitted on both sides of the training pairs.

Rows are columns of weights (struct<idx, weight>).  The right singular vectors
come from subspace iteration: a block of ``components + extra`` directions is
multiplied by A'A, one pass over the rows a time.  Each partition adds up its
share of A'(A q), the shares are summed by feature on the executors, and what
reaches the driver is features x directions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.operators.sparse import WEIGHTS
from inkprint.sources.tables import load_json, save_json


@dataclass(frozen=True)
class ReductionConfig:
    reduce_tfidf: bool = True
    reduce_char_ngrams: bool = True
    reduce_pos_ngrams: bool = True
    tfidf_components: int = 200
    char_ngrams_components: int = 200
    pos_ngrams_components: int = 100
    keep_original: bool = False
    passes: int = 6
    extra: int = 10
    seed: int = 42


#: Families that can be reduced, and the names of their components.
NAMES = {"tfidf": "tfidf_svd", "char_ngrams": "char_tfidf_svd", "pos_ngrams": "pos_tfidf_svd"}
#: Entries that the block of directions may have.
MOST_ENTRIES = 50_000_000


@dataclass(frozen=True)
class Reduction:
    components: np.ndarray  # features x components
    singular: np.ndarray
    explained: float
    features: int = field(default=0)


def effective(requested: int, rows: int, columns: int) -> int:
    return max(1, min(requested, min(rows, columns) - 1))


def matches(family: str, suffix: str) -> bool:
    """Whether the feature ``suffix`` belongs to a family that can be reduced."""
    start = {"tfidf": "tfidf_", "char_ngrams": "char", "pos_ngrams": "pos"}[family]
    return suffix.startswith(start) and (family == "tfidf" or "_tfidf_" in suffix)


def dense(column: Column) -> Column:
    """An array of numbers as a column of weights."""
    return F.struct(F.transform(column, lambda _, i: i.cast("int")).alias("idx"), F.transform(column, lambda x: x.cast("double")).alias("weight"))


def _product(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """A'(A [q, and in the last column A 1's place a one]): features x (directions + 1)."""
    sent = rows.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        out = np.zeros((len(q), q.shape[1] + 1))
        for batch in batches:
            cells = batch.column(0)
            idx, weight = cells.field("idx"), cells.field("weight")
            at, w = idx.flatten().to_numpy(zero_copy_only=False), weight.flatten().to_numpy(zero_copy_only=False)
            ends = idx.offsets.to_numpy() - idx.offsets[0].as_py()
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if b > a:
                    here, x = at[a:b], w[a:b]
                    out[here, :-1] += x[:, None] * (x @ q[here])
                    out[here, -1] += x
        used = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(out[used, j]) for j in range(out.shape[1]))], ["i", *(f"c{j}" for j in range(out.shape[1]))])

    names = [f"c{j}" for j in range(q.shape[1] + 1)]
    shares = rows.mapInArrow(run, "i int, " + ", ".join(f"{n} double" for n in names))
    table = shares.groupBy("i").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((len(q), len(names)))
    out[table.column("i").to_numpy()] = np.column_stack([table.column(n).to_numpy() for n in names]) if table.num_rows else 0
    return out


def fit_svd(vectors: DataFrame, column: str, requested: int, features: int, config: ReductionConfig = ReductionConfig()) -> Reduction:
    """Right singular vectors of the rows of ``column``, and the share of variance that their components have."""
    rows = vectors.select(F.col(column).alias("v"))
    square = F.aggregate("v.weight", F.lit(0.0), lambda s, x: s + x * x)
    n, squares = rows.agg(F.count("*"), F.coalesce(F.sum(square), F.lit(0.0))).first()
    k = effective(requested, n, features)
    width = min(features, k + config.extra)
    if features * width > MOST_ENTRIES:
        raise ValueError(f"{features} features and {k} components are more than the driver may hold")
    q = np.linalg.qr(np.random.default_rng(config.seed).normal(size=(features, width)))[0]
    for step in range(config.passes):
        made = _product(rows, q)
        if step < config.passes - 1:
            q = np.linalg.qr(made[:, :-1])[0]
    values, turn = np.linalg.eigh(q.T @ made[:, :-1])
    order = np.argsort(-values)[:k]
    v = q @ turn[:, order]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    values = np.maximum(values[order], 0.0)
    mean = made[:, -1] / max(n, 1)
    total = squares / max(n, 1) - float((mean * mean).sum())
    inner = float((values / max(n, 1) - (mean @ v) ** 2).sum())
    return Reduction(v, np.sqrt(values), inner / total if total > 0 else 0.0, features)


def project(df: DataFrame, column: str, reduction: Reduction, to: str) -> DataFrame:
    """Add ``to``: the row's components, as a column of weights.  The matrix is sent to the workers once; fitting bounds it."""
    sent = df.sparkSession.sparkContext.broadcast(reduction.components)

    @F.pandas_udf(WEIGHTS)
    def projected(idx: pd.Series, weight: pd.Series) -> pd.DataFrame:
        matrix = sent.value
        made = [w @ matrix[i] if len(i) else np.zeros(matrix.shape[1]) for i, w in zip(idx, weight)]
        return pd.DataFrame({"idx": [np.arange(len(x), dtype=np.int32) for x in made], "weight": made})

    return df.withColumn(to, projected(F.col(column)["idx"], F.col(column)["weight"]))


def reduce_families(sides: DataFrame, sizes: dict[str, int], config: ReductionConfig = ReductionConfig()) -> tuple[DataFrame, DataFrame, dict[str, Reduction]]:
    """(sides with each family's components, summary, the reductions); ``sides`` has split and a column of weights for each family.

    Components take the place of the family's column, or with ``keep_original``
    go beside it, named as in NAMES.  The summary has family,
    original_base_features, reduced_components, explained_variance_ratio_sum.
    """
    made, rows = {}, []
    for family, name in NAMES.items():
        if not getattr(config, f"reduce_{family}") or family not in sizes:
            continue
        train = sides.where("split = 'train'")
        made[family] = fit_svd(train, family, getattr(config, f"{family}_components"), sizes[family], config)
        sides = project(sides, family, made[family], name)
        if not config.keep_original:
            sides = sides.drop(family)
        rows.append((family, sizes[family], made[family].components.shape[1], round(made[family].explained, 6)))
    summary = sides.sparkSession.createDataFrame(rows, "family string, original_base_features int, reduced_components int, explained_variance_ratio_sum double")
    return sides, summary, made


def save_reductions(spark: SparkSession, reductions: dict[str, Reduction], folder: str) -> None:
    """One table of components and one JSON file a family."""
    for family, r in reductions.items():
        rows = [(i, row.tolist()) for i, row in enumerate(r.components)]
        spark.createDataFrame(rows, "idx int, components array<double>").write.mode("overwrite").parquet(f"{folder}/{family}")
        save_json({"singular": r.singular, "explained": r.explained, "features": r.features}, f"{folder}/{family}.json")


def load_reductions(spark: SparkSession, folder: str, families: tuple[str, ...] = tuple(NAMES)) -> dict[str, Reduction]:
    out = {}
    for family in families:
        told = load_json(f"{folder}/{family}.json")
        rows = sorted(spark.read.parquet(f"{folder}/{family}").collect())
        out[family] = Reduction(np.array([r["components"] for r in rows]), np.array(told["singular"]), told["explained"], told["features"])
    return out
