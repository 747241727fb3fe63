"""Sparse term features: content lemmas, character and part-of-speech n-grams, vocabulary, TF-IDF.

Everything stays in long form: (keys..., term, tf) rows, summed per text before
any join, so a long or repeated text costs one row a term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.functions.lexicon import CONTENT_POS, function_words, stop_words
from inkprint.functions.text import words
from inkprint.operators.stats import is_word


@dataclass(frozen=True)
class TermConfig:
    family: str
    min_df: int | float = 2
    max_df: int | float = 0.95
    max_features: int | None = 25_000


LEMMAS = TermConfig("tfidf")
CHARS = TermConfig("char_ngrams", max_features=50_000)
POS = TermConfig("pos_ngrams", max_features=5_000)


def char_grams(text: Column, n: int = 4) -> Column:
    """Character n-grams inside words; a shorter word stays whole."""
    grams = F.transform(words(text), lambda w: F.when(F.length(w) < n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - (n - 1))), lambda i: F.substring(w, i, F.lit(n)))))
    return F.flatten(grams)


def keep_token(t: Column, function_list: tuple[str, ...], stop_list: tuple[str, ...], pos: tuple[str, ...] = CONTENT_POS, least: int = 2) -> Column:
    """Content words: a letter in the lemma, an allowed part of speech, in neither word list, no placeholder."""
    lemma = F.lower(t["lemma"])
    marked = t["text"].startswith("<") & t["text"].endswith(">")
    return t["pos"].isin(*pos) & is_word(t) & ~marked & (F.length(lemma) >= least) & ~lemma.isin(*function_list) & ~lemma.isin(*stop_list) & lemma.rlike(r"\p{L}")


def content_lemmas(tokens: Column, function_list: tuple[str, ...] | None = None, stop_list: tuple[str, ...] | None = None) -> Column:
    lists = function_list or function_words(), stop_list if stop_list is not None else stop_words()
    return F.transform(F.filter(tokens, lambda t: keep_token(t, *lists)), lambda t: F.lower(t["lemma"]))


def pos_sequence(tokens: Column) -> Column:
    return F.transform(F.filter(tokens, is_word), lambda t: t["pos"])


def _runs(items: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(items) - (n - 1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), " "))
    return F.when(F.size(items) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngrams(items: Column, least: int, most: int) -> Column:
    """All runs of ``least`` to ``most`` items, joined by a blank.

    The items are bound to a lambda variable, so they are computed once and not
    once for each run.
    """
    bound = F.transform(F.array(items), lambda one: F.concat(*(_runs(one, n) for n in range(least, most + 1))))
    return F.element_at(bound, 1)


def term_counts(df: DataFrame, terms: Column, keys: list[str]) -> DataFrame:
    """(keys, term, tf)."""
    return df.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, documents: int, config: TermConfig) -> DataFrame:
    """(term, term_idx, df, tf, idf) from training counts: document-frequency bounds, the most frequent terms, ties by term.

    idf = ln((1 + N) / (1 + df)) + 1; indices follow the order of the terms.
    """
    table = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    low = config.min_df if isinstance(config.min_df, int) else config.min_df * documents
    high = config.max_df if isinstance(config.max_df, int) else config.max_df * documents
    table = table.where((F.col("df") >= low) & (F.col("df") <= high))
    if config.max_features is not None:
        table = table.orderBy(F.desc("tf"), "term").limit(config.max_features)
    # At most max_features rows from here; without a bound the index costs one sort.
    return table.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("term_idx"), "df", "tf", (F.log((F.lit(1.0) + documents) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, term_idx, weight): (1 + ln tf) * idf over its L2 norm; unknown terms are dropped.

    For vocabularies of any size: whether they are broadcast is left to what
    their size turns out to be.  ``sparse.weights`` does the same in the row.
    """
    joined = counts.join(vocab.select("term", "term_idx", "idf"), "term").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*keys)))
    return joined.withColumn("weight", F.col("raw") / norm).select(*keys, "term", "term_idx", "weight")


def density(weighed: DataFrame, columns: list[str], by: list[str], digits: int | None = 5) -> DataFrame:
    """Mean number of non-zero terms a row of each of ``columns`` of weights, and rows, by group."""
    r = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    means = [r(F.avg(F.size(F.col(c)["idx"]))).alias(f"{c}_density") for c in columns]
    return weighed.groupBy(*by).agg(F.count("*").alias("num_rows"), *means)


def summary(sides: DataFrame, vocabs: dict[str, DataFrame], digits: int = 5) -> DataFrame:
    """One row a split: pairs, size of each vocabulary, and each side's density of each family.

    ``sides`` has split, side and a column of weights named like each vocabulary.
    """
    cells = [F.bround(F.avg(F.when(F.col("side") == side, F.size(F.col(f)["idx"]))), digits).alias(f"{side}_{f}_density") for f in vocabs for side in ("text1", "text2")]
    sizes = [F.lit(v.count()).alias(f"{f}_vocabulary_size") for f, v in vocabs.items()]
    made = sides.groupBy("split").agg(F.count_if(F.col("side") == "text1").alias("num_rows"), *cells)
    return made.select("split", "num_rows", *sizes, *(c for c in made.columns if c.endswith("_density")))
