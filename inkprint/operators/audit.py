"""Pair tables: validity and length filters, symmetric dedup, length and label summaries.

A pair table has pair_id, split, text1, text2, same.  Order is explicit: splits
rank train, validation, test, and rows by pair_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.functions.text import rounded, strip, word_count

SPLITS = ("train", "validation", "test")


def split_rank() -> Column:
    return F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))


def union_splits(frames: dict[str, DataFrame]) -> DataFrame:
    """One table with a ``split`` column out of one frame for each split."""
    out = None
    for split, frame in frames.items():
        tagged = frame.withColumn("split", F.lit(split))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def valid(pairs: DataFrame) -> DataFrame:
    """Rows whose texts aren't blank and whose label is 0 or 1."""
    filled = lambda c: F.coalesce(F.length(strip(F.col(c))) > 0, F.lit(False))
    return pairs.where(filled("text1") & filled("text2") & F.col("same").isin(0, 1))


def within_words(pairs: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows both of whose texts have a word count in [least, most]; a bound of None is open."""
    if least is None and most is None:
        return pairs
    for c in ("text1", "text2"):
        n = word_count(F.col(c))
        pairs = pairs.where((n >= least if least is not None else F.lit(True)) & (n <= most if most is not None else F.lit(True)))
    return pairs


def symmetric_key() -> list[Column]:
    """The unordered pair of texts with its label, as two 64-bit digests of each text.

    Shuffling digests instead of texts keeps the dedup narrow.
    """
    low, high = F.least("text1", "text2"), F.greatest("text1", "text2")
    return [F.sha2(low, 256).alias("low"), F.sha2(high, 256).alias("high"), F.col("same")]


def duplicates(pairs: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one's symmetric key."""
    keyed = pairs.select(*symmetric_key())
    return keyed.groupBy("low", "high", "same").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def dedup(pairs: DataFrame) -> DataFrame:
    """Keep the first row of each symmetric key, in split order and then by pair_id.

    The first row is a minimum, so it is found with a partial aggregate before
    the shuffle; a pair with both labels stays twice.
    """
    keyed = pairs.withColumns({"_low": F.sha2(F.least("text1", "text2"), 256), "_high": F.sha2(F.greatest("text1", "text2"), 256)})
    first = keyed.groupBy("_low", "_high", "same").agg(F.min(F.struct(split_rank().alias("s"), F.col("pair_id").alias("p"))).alias("first"))
    keep = first.select(F.col("first.s").alias("_s"), F.col("first.p").alias("pair_id"))
    return pairs.withColumn("_s", split_rank()).join(keep, ["_s", "pair_id"], "left_semi").drop("_s")


def audit(pairs: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    return dedup(within_words(valid(pairs), least, most))


def length_stats(pairs: DataFrame, side: str, digits: int | None = 2) -> list[Column]:
    r = (lambda c: rounded(c, digits)) if digits is not None else (lambda c: c)
    out = []
    for unit, value in (("word", word_count(F.col(side))), ("char", F.length(side))):
        out += [
            r(F.median(value)).alias(f"{side}_median_{unit}_length"),
            r(F.avg(value)).alias(f"{side}_mean_{unit}_length"),
            r(F.stddev_samp(value)).alias(f"{side}_std_{unit}_length"),
        ]
    return out


def summary(pairs: DataFrame, digits: int | None = 2) -> DataFrame:
    """Rows, labels and lengths of each split."""
    ones = F.count_if(F.col("same") == 1)
    ratio = F.coalesce(F.try_divide(ones.cast("double"), F.count("*").cast("double")), F.lit(0.0))
    labels = [F.count("*").alias("rows"), F.count_if(F.col("same") == 0).alias("label_0"), ones.alias("label_1"), (rounded(ratio, 4) if digits is not None else ratio).alias("label_1_ratio")]
    return pairs.groupBy("split").agg(*labels, *length_stats(pairs, "text1", digits), *length_stats(pairs, "text2", digits))


def normalization_summary(pairs: DataFrame, digits: int | None = 2) -> DataFrame:
    r = (lambda c: rounded(c, digits)) if digits is not None else (lambda c: c)
    means = [r(F.avg(f(F.col(c)))).alias(f"{c}_mean_{unit}_length") for c in ("text1", "text2") for unit, f in (("word", word_count), ("char", F.length))]
    return pairs.groupBy("split").agg(*means)


def sides(pairs: DataFrame) -> DataFrame:
    """Long form: one row for each pair and side, with ``side`` and ``text``."""
    keep = [c for c in pairs.columns if c not in ("text1", "text2")]
    sided = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in ("text1", "text2"))))
    return pairs.select(*keep, sided.alias("_s")).select(*keep, "_s.side", "_s.text")


#: Values of the distribution function that share a cell, and rows made out of one at a time.
CELL, RUN = 4096, 10_000


def ecdf(df: DataFrame, value: Column) -> DataFrame:
    """Empirical distribution of an integer ``value``: x sorted, y = rank / count; ties get ranks of their own.

    Values are counted first.  Rows below a value come from sums over cells of
    ``CELL`` values and from a window within its cell; a value of very many rows
    is unfolded in runs, so no row holds more than ``RUN`` ranks.
    """
    groups = df.select(value.alias("x")).groupBy("x").agg(F.count("*").alias("_k")).withColumn("_cell", F.floor(F.col("x") / CELL))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cells = groups.groupBy("_cell").agg(F.sum("_k").alias("_c"))
    lower = cells.select("_cell", F.coalesce(F.sum("_c").over(upto(Window.orderBy("_cell"))), F.lit(0)).alias("_lower"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    ranked = groups.withColumn("_own", F.coalesce(F.sum("_k").over(upto(Window.partitionBy("_cell").orderBy("x"))), F.lit(0))).join(F.broadcast(lower), "_cell")
    runs = ranked.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_k") - 1) / RUN))))
    ranks = F.sequence(F.col("_run") * RUN + 1, F.least(F.col("_k"), (F.col("_run") + 1) * RUN))
    return runs.select("x", F.explode(ranks).alias("_i"), "_lower", "_own", "_n").select("x", ((F.col("_lower") + F.col("_own") + F.col("_i")) / F.col("_n")).alias("y"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Rows in each of ``bins`` equal bins of [low, high]; the last bin is closed, other rows are left out."""
    x = value.cast("double")
    at = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.select(x.alias("x"), at.alias("bin")).where(F.col("x").between(low, high)).groupBy("bin").agg(F.count("*").alias("n"))
