"""Term counts and weights kept in the row of their text, as sparse arrays.

A text's n-grams are counted where the text is, so nothing is shuffled but the
vocabulary; weights are looked up in a vocabulary of checked size; a pair's
features come from the two arrays side by side.  SQL has no function that counts
an array's values or merges two sparse arrays, so these few steps run over Arrow
batches, ``ROWS`` rows at a time; all else is native.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from inkprint.operators.terms import TermConfig, tfidf, vocabulary

COUNTS = "struct<terms:array<string>,tf:array<int>>"
WEIGHTS = "struct<idx:array<int>,weight:array<double>>"
DISTANCES = "struct<terms:long,abs_diff:double,product:double,cosine:double,l1:double,l2:double>"
#: A vocabulary is sent to every worker up to so many terms; a larger one is joined by a shuffle.
MOST_TERMS = 200_000
#: Rows whose results are made and handed on at a time, so what a worker holds doesn't grow with the batches it gets.
ROWS = 128


def pieces(make: Callable[..., pa.Array], batches: Iterator) -> Iterator[pa.Array]:
    """``make``, a function of columns, of ``ROWS`` rows of each batch at a time."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for at in range(0, len(columns[0]), ROWS):
            yield make(*(c.slice(at, ROWS) for c in columns))


def by_rows(make: Callable[..., pa.Array], returns: str) -> Callable[..., Column]:
    return F.arrow_udf(lambda batches: pieces(make, batches), returns, ArrowUDFType.SCALAR_ITER)


def sizes_of(lists: pa.ListArray) -> np.ndarray:
    """Length of each list; a null is empty."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def lists_of(sizes, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _counted(items: Iterator, count: Callable[[object], Counter]) -> pa.StructArray:
    made = [count(x) if x is not None else Counter() for x in items]
    sizes = [len(c) for c in made]
    terms, tf = pa.array([t for c in made for t in c], pa.string()), pa.array([n for c in made for n in c.values()], pa.int32())
    return pa.StructArray.from_arrays([lists_of(sizes, terms), lists_of(sizes, tf)], ["terms", "tf"])


def grams(n: int = 4) -> Callable[[str], Counter]:
    """How the character ``n``-grams inside the words of a text are counted; a shorter word stays whole."""

    def count(text: str) -> Counter:
        out: Counter = Counter()
        for word, times in Counter(text.split()).items():
            for i in range(max(1, len(word) - n + 1)):
                out[word[i : i + n]] += times
        return out

    return count


def runs(least: int, most: int) -> Callable[[list[str]], Counter]:
    """How all runs of ``least`` to ``most`` of some items, joined by a blank, are counted."""
    return lambda items: Counter(" ".join(run) for n in range(least, most + 1) for run in zip(*(items[i:] for i in range(n))))


def all_counts(families: dict[str, tuple[Column, Callable[[object], Counter]]]) -> Column:
    """A struct of the counts of several families, so that a row goes to a worker once."""
    names, ways = list(families), [count for _, count in families.values()]

    def made(*columns: pa.Array) -> pa.StructArray:
        return pa.StructArray.from_arrays([_counted(c.to_pylist(), count) for c, count in zip(columns, ways)], names)

    return by_rows(made, f"struct<{','.join(f'{name}:{COUNTS}' for name in families)}>")(*(c for c, _ in families.values()))


def gram_counts(text: Column, n: int = 4) -> Column:
    """Counts of the character ``n``-grams inside the words of ``text``; a shorter word stays whole."""
    return all_counts({"c": (text, grams(n))})["c"]


def ngram_counts(items: Column, least: int, most: int) -> Column:
    """Counts of all runs of ``least`` to ``most`` of the array ``items``, joined by a blank."""
    return all_counts({"c": (items, runs(least, most))})["c"]


def long_counts(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, term, tf) of a column of counts; no shuffle."""
    return df.select(*keys, F.explode(F.arrays_zip(F.col(f"{column}.terms").alias("term"), F.col(f"{column}.tf").alias("tf"))).alias("c")).select(*keys, "c.term", F.col("c.tf").cast("long").alias("tf"))


def fit(df: DataFrame, column: str, documents: int, config: TermConfig) -> DataFrame:
    """The vocabulary of a column of counts over the rows of ``df``."""
    return vocabulary(long_counts(df, column, []), documents, config)


def weights(df: DataFrame, column: str, vocab: DataFrame, to: str, keys: list[str]) -> DataFrame:
    """Add ``to``: (1 + ln tf) * idf over its L2 norm, by ascending term_idx; unknown terms are dropped.

    ``keys`` name a row; they are used only where the vocabulary is too large to
    be sent to the workers.
    """
    table = vocab.select("term", "term_idx", "idf")
    if table.count() > MOST_TERMS:
        long = tfidf(long_counts(df, column, keys), vocab, keys)
        pairs = F.array_sort(F.collect_list(F.struct("term_idx", "weight")))
        rows = long.groupBy(*keys).agg(pairs.alias("w")).select(*keys, F.struct(F.col("w.term_idx").alias("idx"), F.col("w.weight").alias("weight")).alias(to))
        none = F.struct(F.array().cast("array<int>").alias("idx"), F.array().cast("array<double>").alias("weight"))
        return df.join(rows, keys, "left").withColumn(to, F.coalesce(to, none))
    rows = table.collect()
    sent = df.sparkSession.sparkContext.broadcast((pa.array([r["term"] for r in rows], pa.string()), np.array([r["term_idx"] for r in rows], np.int32), np.array([r["idf"] for r in rows], float)))

    def weighed(terms: pa.ListArray, tf: pa.ListArray) -> pa.StructArray:
        words, indices, idf = sent.value
        sizes = sizes_of(terms)
        row = np.repeat(np.arange(len(sizes)), sizes)
        hit = pc.index_in(terms.flatten(), words)
        known = hit.is_valid().to_numpy(zero_copy_only=False)
        hit, row = hit.drop_null().to_numpy(zero_copy_only=False), row[known]
        raw = (1 + np.log(_numbers(tf)[known].astype(float))) * idf[hit]
        norm = np.sqrt(np.bincount(row, raw * raw, len(sizes)))
        order = np.lexsort((indices[hit], row))
        made = np.bincount(row, minlength=len(sizes))
        return pa.StructArray.from_arrays([lists_of(made, pa.array(indices[hit][order], pa.int32())), lists_of(made, pa.array((raw / norm[row])[order], pa.float64()))], ["idx", "weight"])

    return df.withColumn(to, by_rows(weighed, WEIGHTS)(F.col(f"{column}.terms"), F.col(f"{column}.tf")))


def long_weights(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, term_idx, weight) of a column of weights; no shuffle."""
    cells = F.explode(F.arrays_zip(F.col(f"{column}.idx").alias("term_idx"), F.col(f"{column}.weight").alias("weight")))
    return df.select(*keys, cells.alias("c")).select(*keys, "c.term_idx", "c.weight")


def _aligned(left_idx: pa.ListArray, left: pa.ListArray, right_idx: pa.ListArray, right: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and index of what either side has, by row and index, and both sides' weights there (0 where a side has none)."""
    keys = [(np.repeat(np.arange(len(i)), sizes_of(i)) << 32) | _numbers(i).astype(np.int64) for i in (left_idx, right_idx)]
    every = np.union1d(*keys)
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, keys[0])] = _numbers(left)
    b[np.searchsorted(every, keys[1])] = _numbers(right)
    return every >> 32, every & 0xFFFFFFFF, a, b


def _parts(column: Column) -> tuple[Column, Column]:
    return column["idx"], column["weight"]


def distances(left: Column, right: Column) -> Column:
    """Of two columns of weights: terms of either, sums of |a - b| and a * b, cosine (0 where a side is empty), l1, l2."""

    def measured(*sides: pa.ListArray) -> pa.StructArray:
        row, _, a, b = _aligned(*sides)
        total = lambda values: np.bincount(row, values, len(sides[0]))
        norm, off, dot = np.sqrt(total(a * a)) * np.sqrt(total(b * b)), total(np.abs(a - b)), total(a * b)
        cosine = np.divide(dot, norm, out=np.zeros(len(dot)), where=norm > 0)
        made = [np.bincount(row, minlength=len(sides[0])), off, dot, cosine, off, np.sqrt(total((a - b) * (a - b)))]
        return pa.StructArray.from_arrays([pa.array(m) for m in made], ["terms", "abs_diff", "product", "cosine", "l1", "l2"])

    return by_rows(measured, DISTANCES)(*_parts(left), *_parts(right))


def pair_vector(sides: list[tuple[Column, Column, int]], rest: Column, size: int) -> Column:
    """A sparse vector in its stored form: |a - b| of suffix n at 2n and a * b at 2n + 1, then the numbers of ``rest``.

    ``sides`` has both columns of weights of each family and the number of its
    first suffix.
    """
    starts = [first for _, _, first in sides]

    def made(last: pa.ListArray, *columns: pa.ListArray) -> pa.StructArray:
        n, tails = len(last), sizes_of(last)
        within = np.arange(tails.sum()) - np.repeat(np.cumsum(tails) - tails, tails)
        rows, at, values = [np.repeat(np.arange(n), tails)], [size - np.repeat(tails, tails) + within], [_numbers(last).astype(float)]
        for k, first in enumerate(starts):
            row, index, a, b = _aligned(*columns[4 * k : 4 * k + 4])
            rows += [row, row]
            at += [2 * (index + first), 2 * (index + first) + 1]
            values += [np.abs(a - b), a * b]
        row, at, value = np.concatenate(rows), np.concatenate(at), np.concatenate(values)
        order = np.lexsort((at, row))
        order = order[value[order] != 0]
        sizes = np.bincount(row[order], minlength=n)
        indices, kept = lists_of(sizes, pa.array(at[order], pa.int32())), lists_of(sizes, pa.array(value[order], pa.float64()))
        return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), indices, kept], ["type", "size", "indices", "values"])

    return by_rows(made, "struct<type:byte,size:int,indices:array<int>,values:array<double>>")(rest, *(part for left, right, _ in sides for side in (left, right) for part in _parts(side)))
