"""Reproducible global shuffle into shards by a Feistel permutation with cycle walking.

Everything is a DataFrame expression: no Python runs on the executors.

1.  Each row gets a global number in [0, N).  Equal rows are counted, added up
    before the shuffle, and the counts are written: texts are read once, and a
    row that occurs any number of times is one entry.  Entries are dealt into
    hash buckets; bucket sums give offsets (one row a bucket, so the prefix sum
    and its broadcast are bounded by the number of buckets), and running sums
    inside a bucket the rest.  The numbers of an entry are unfolded in runs.
2.  A balanced Feistel network over the grid [0, a) x [0, b), a*b >= N, with
    modular addition permutes that grid; numbers outside [0, N) are walked
    through the network again until they fall inside.
3.  ``shard = p mod shards`` and ``slot = p div shards``: shard sizes differ by
    one row at most, and slots of a shard have no gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.llm.common import materialise

ROUNDS = 6
#: a*b - N < a = ceil(sqrt(N)) numbers lie outside.  Up to 64 * 64 rows a walk
#: can't be longer than this; beyond, each further step is taken with
#: probability below 1/64, and a walk that did not end raises.
WALK = 64
BUCKETS = 4096
#: Numbers of equal rows that are unfolded in one place.
RUN = 10_000


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def network(x: Column, a: Column, b: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass of the Feistel network: a permutation of [0, a*b)."""
    left, right = _div(x, b), x % b
    for i in range(rounds):
        if i % 2 == 0:
            left = (left + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), right), a)) % a
        else:
            right = (right + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), left), b)) % b
    return left * b + right


def permute(df: DataFrame, number: str, total: str, seed: int, to: str) -> DataFrame:
    """Add column ``to``: the image of ``number`` under a permutation of [0, ``total``)."""
    side = F.ceil(F.sqrt(F.col(total).cast("double"))).cast("long")
    grid = df.withColumn("_a", side).withColumn("_b", _div(F.col(total) + side - 1, side))
    once = grid.withColumn("_p", network(F.col(number), F.col("_a"), F.col("_b"), seed))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        F.col("_p"),
        lambda p, _: F.when(p < F.col(total), p).otherwise(network(p, F.col("_a"), F.col("_b"), seed)),
    )
    ended = once.withColumn("_p", F.when(F.col("_p") < F.col(total), F.col("_p")).otherwise(walked))
    inside = F.when(F.col("_p") < F.col(total), F.col("_p")).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))
    return ended.withColumn(to, inside).drop("_a", "_b", "_p")


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 20240, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """Deal ``docs`` (doc_id, text) into ``shards`` shards under the law ``rows``.

    Returns one row per input row: doc_id, size, text_crc32, law, shard, slot,
    grown_shard.  The same rows and seed give the same result on any cluster.

    A null text has 0 bytes (size 16, crc 0); a very long one is read once.  A
    null doc_id is a value like any other.  Rows equal in doc_id and text are
    interchangeable and get distinct places; any number of them is one row until
    their places are unfolded, ``run`` at a time.  An empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    alike = rows.groupBy("doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    groups = materialise(alike.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets))), "groups")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = groups.groupBy("bucket").agg(F.sum("n").alias("own"))
    counts = counts.select("bucket", F.coalesce(F.sum("own").over(upto(Window.orderBy("bucket"))), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy()).alias("total"))
    inside = F.sum("n").over(upto(Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")))
    first = groups.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(counts), "bucket").withColumn("first", F.col("before") + F.col("inside"))
    kept = ["doc_id", "size", "text_crc32", "total", "first", "n"]
    few = first.where(F.col("n") <= run).select(*kept, F.lit(0).cast("long").alias("run"))
    many = first.where(F.col("n") > run).select(*kept, F.explode(F.sequence(F.lit(0), _div(F.col("n") - 1, F.lit(run)))).alias("run"))
    runs = few.unionByName(many.repartition("first", "run"))
    within = F.explode(F.sequence(F.lit(0), F.least(F.lit(run), F.col("n") - F.col("run") * run) - 1))
    numbered = runs.select(*kept, "run", within.alias("at")).withColumn("number", F.col("first") + F.col("run") * run + F.col("at"))
    placed = permute(numbered, "number", "total", seed, "place")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        _div(F.col("place"), F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
