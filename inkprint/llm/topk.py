"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each component of a block of vectors is one list of (value, vector), sorted by
value.  For a query a list's entry is worth weight times value; it is read in
order from its best end, the top for a positive weight and the bottom for a
negative one.  What has been read of a vector adds up to a partial score; an
entry not yet read is worth no more than the list's frontier and no less than
its far end, which gives each vector an upper and a lower bound.

Lists whose best and far ends lie widest apart are read first, so those that
can't change the order are left for last, and one list at a time: then nothing
but the list being read tells vectors apart by what isn't known of them.  A
vector whose upper bound is under the k-th lower bound can't qualify any more
and is dropped.  Once few are left, reading goes on for these alone until their
scores are final.  No list is ever entered at a vector's place.  All bounds are
integers held in float64, so they are exact.

Queries and vectors are cut into blocks of bounded size and meet block by
block; each meeting keeps k rows a query, and a partial rank limit goes before
the last shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A list is read in this many steps.
STEPS = 2
#: Bounds are looked at again once what isn't known has shrunk to this share.
SHRUNK = 0.85


def integers(vector: str, scale: int = 1024) -> str:
    """SQL for the components as floor(scale * x), x as double."""
    return f"transform({vector}, x -> cast(floor({scale}D * cast(x as double)) as bigint))"


def usable(vector: str) -> str:
    """SQL: the vector and all its components are non-null and finite."""
    return f"{vector} is not null and forall({vector}, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"


@dataclass
class Lists:
    """Sorted lists of a block: entry i of list j is vector ``who[j, i]`` with value ``value[j, i]``, ascending."""

    who: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, block: np.ndarray) -> Lists:
        columns = np.ascontiguousarray(block.T)
        who = np.argsort(columns, axis=1, kind="stable").astype(np.int32)
        return cls(who, np.take_along_axis(columns, who, axis=1))


class Reader:
    """Reads the lists for one query; ``read`` counts the entries read, ``decided`` those until few vectors were left."""

    def __init__(self, lists: Lists, weights: np.ndarray):
        self.lists, self.weights = lists, weights
        self.width, self.n = lists.who.shape
        rising = weights < 0
        self.rising = rising.tolist()
        first, last = lists.value[:, 0], lists.value[:, -1]
        self.far = weights * np.where(rising, last, first)
        self.frontier = weights * np.where(rising, first, last)
        self.order = np.argsort(self.far - self.frontier, kind="stable").tolist()
        self.depth = [0] * self.width
        self.at = 0  # how many lists are read to their end
        self.partial = np.zeros(self.n)
        #: Vectors met in the list that is being read.
        self.met = np.zeros(self.n, bool)
        #: What the lists not begun are worth at most and at least.
        self.most, self.least = float(self.frontier.sum()), float(self.far.sum())
        self.alive = np.arange(self.n)
        self.read = self.decided = 0

    def step(self, entries: int) -> np.ndarray:
        """Read the current list on by so many entries, in order: the vectors met."""
        j = self.order[self.at]
        if not self.depth[j]:
            self.most -= self.frontier[j]
            self.least -= self.far[j]
        a, b = self.depth[j], min(self.n, self.depth[j] + entries)
        part = slice(a, b) if self.rising[j] else slice(self.n - b, self.n - a)
        who, worth = self.lists.who[j, part], self.weights[j] * self.lists.value[j, part]
        self.partial[who] += worth
        self.depth[j], self.read = b, self.read + b - a
        self.frontier[j] = worth[-1] if self.rising[j] else worth[0]
        if b == self.n:
            self.at += 1
            self.met[:] = False
        else:
            self.met[who] = True
        return who

    def gap(self) -> float:
        """How far the bounds of a vector are apart that isn't met in the current list."""
        now = self.order[self.at] if self.at < self.width else None
        begun = now is not None and self.depth[now] > 0
        return self.most - self.least + (float(self.frontier[now] - self.far[now]) if begun else 0.0)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the score of each vector alive."""
        known, low, high = self.partial[self.alive], self.least, self.most
        now = self.order[self.at] if self.at < self.width else None
        if now is not None and self.depth[now]:
            met = self.met[self.alive]
            low, high = low + np.where(met, 0.0, self.far[now]), high + np.where(met, 0.0, self.frontier[now])
        return known + low, known + high

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices and final scores of all vectors that may be among the ``k`` best: ``k`` at least, unless there are fewer."""
        looked = math.inf
        while len(self.alive) > 4 * k and self.at < self.width:
            self.step(-(-self.n // STEPS))
            if (gap := self.gap()) > SHRUNK * looked:
                continue
            looked = gap
            lower, upper = self.bounds()
            self.alive = self.alive[upper >= np.partition(lower, len(lower) - k)[len(lower) - k]]
        self.decided = self.read
        self.resolve()
        return self.alive, self.partial[self.alive]

    def resolve(self) -> None:
        """Read the rest of the lists, each on to the last entry of a vector alive; the others' entries are passed over."""
        wanted = np.zeros(self.n, bool)
        wanted[self.alive] = True
        for j in self.order[self.at :]:
            a = self.depth[j]
            rest = self.lists.who[j, a:] if self.rising[j] else self.lists.who[j, : self.n - a][::-1]
            hits = np.flatnonzero(wanted[rest])
            if len(hits):
                value = self.lists.value[j, a:] if self.rising[j] else self.lists.value[j, : self.n - a][::-1]
                self.partial[rest[hits]] += self.weights[j] * value[hits]
                self.read += int(hits[-1]) + 1


def aggregate_block(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float]]]:
    """Per query: (repeated query id, vector ids, scores) of its k best in this block, best first, and the shares of all entries that were read: until few vectors were left, and in all."""
    lists = Lists.of(block)
    for query_id, weights in zip(query_ids.tolist(), queries):
        reader = Reader(lists, weights)
        others = ids != query_id
        reader.alive = reader.alive[others]
        at, score = reader.best(k)
        order = np.lexsort((ids[at], -score))[:k]
        yield np.full(len(order), query_id), ids[at][order], score[order], (reader.decided / block.size, reader.read / block.size)


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for at, row in enumerate(rows):
        out[at, : len(row)] = row
    return out


def _exact(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For components too large for float64: arithmetic on Python integers, kept within 64 bits at the end."""
    limit = 2**63
    for q, w in zip(queries["vec_id"], queries["v"]):
        scored = sorted(((-max(-limit, min(limit - 1, sum(int(a) * int(b) for a, b in zip(v, w)))), i) for i, v in zip(vectors["vec_id"], vectors["v"]) if i != q))[:k]
        yield np.full(len(scored), q), np.array([i for _, i in scored], np.int64), np.array([-s for s, _ in scored], np.int64)


def _meet(k: int):
    def meet(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        names = ("query_id", "vec_id", "score")
        if not len(queries) or not len(vectors):
            return pd.DataFrame({name: [] for name in names}, dtype="int64")
        width = max(1, *(len(v) for v in vectors["v"]), *(len(v) for v in queries["v"]))
        block, asked = _matrix(list(vectors["v"]), width), _matrix(list(queries["v"]), width)
        if np.abs(block).max() * np.abs(asked).max() * width < 2**51:
            found = list(aggregate_block(vectors["vec_id"].to_numpy(), block, queries["vec_id"].to_numpy(), asked, k))
        else:
            found = list(_exact(vectors, queries, k))
        return pd.DataFrame({name: np.concatenate([x[i] for x in found]).astype("int64") for i, name in enumerate(names)})

    return meet


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 8192, asked: int = 4096) -> DataFrame:
    """The ``k`` best of ``vectors`` for each row of ``queries`` (both: vec_id, embedding).

    Returns query_id, rank, vec_id, score; ties go to the smaller vec_id.  A
    query never meets rows of its own id.  Null ids, null vectors and vectors
    with a null or non-finite component take no part.  Shorter vectors, however
    long the longest, count as padded with zeros.  Repeated candidate rows each
    take a rank (``k`` copies are all that can, so no more are sent); repeated
    query rows are asked once.  Fewer than k candidates give fewer rows, an
    empty table none.  Other columns, whatever their names, are ignored.
    """
    whole = lambda df: df.where(f"vec_id is not null and {usable('embedding')}").selectExpr("cast(vec_id as bigint) as vec_id", f"{integers('embedding')} as v")
    copies = whole(vectors).groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    rows = copies.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy")).drop("copy")
    wanted = whole(queries).dropDuplicates(["vec_id", "v"])
    blocks = max(1, math.ceil(vectors.count() / block))
    asks = max(1, math.ceil(queries.count() / asked))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    wanted = wanted.withColumn("ask", F.pmod(F.xxhash64("vec_id", "v", F.lit(2)), F.lit(asks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = wanted.groupBy("ask", "block").cogroup(rows.groupBy("ask", "block")).applyInPandas(_meet(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
