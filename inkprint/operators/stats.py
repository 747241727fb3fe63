"""Stylometric statistics of linguistic records, as expressions over their arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.lexicon import CLAUSAL, DEP_ROLES, POS_ROLES, function_words
from inkprint.functions.text import safe_rate


def is_word(t: Column) -> Column:
    return ~t["is_punct"] & ~t["is_space"]


def is_placeholder(text: Column) -> Column:
    return text.rlike(r"^<[^<>]+>$")


def word_tokens(tokens: Column) -> Column:
    return F.filter(tokens, is_word)


PHRASES = ("phrase_noun_phrase_rate", "phrase_prepositional_phrase_rate", "phrase_clausal_phrase_rate")
BASIC = ("avg_sentence_length_words", "avg_function_words_per_sentence", "punctuation_rate", "avg_word_length", "function_word_rate")
NAMES = (*BASIC, *PHRASES, *(f"pos_{n}_rate" for n in POS_ROLES), *(f"dep_{n}_rate" for n in DEP_ROLES))


def token_counts(records: DataFrame, keys: list[str], function_list: tuple[str, ...]) -> DataFrame:
    """Counts of each record's tokens by part of speech and role: one pass over the tokens, added up before the only shuffle that has many rows.

    ``keys`` name a record.  A record without sentences is one sentence; one
    without tokens gets one row of zeros.
    """
    sized = records.select(*keys, F.greatest(F.lit(1), F.size("sentences")).alias("_sentences"), F.size("chunks").alias("_chunks"), F.explode_outer("tokens").alias("t"))
    t = F.col("t")
    word, spelt = is_word(t), is_word(t) & ~is_placeholder(t["text"])
    counts = {
        "_words": F.count_if(word),
        "_signs": F.count_if(t["is_punct"]),
        "_seen": F.count_if(~t["is_space"]),
        "_known": F.count_if(word & t["lower"].isin(*function_list)),
        "_spelt": F.count_if(spelt),
        "_chars": F.coalesce(F.sum(F.when(spelt, F.length(t["text"]))), F.lit(0)),
        "_all": F.count("t"),
    }
    return sized.groupBy(*keys, "_sentences", "_chunks", t["pos"].alias("_pos"), t["dep"].alias("_dep")).agg(*(c.alias(n) for n, c in counts.items()))


def document_statistics(records: DataFrame, keys: list[str], function_list: tuple[str, ...] | None = None, digits: int | None = 3) -> DataFrame:
    """``keys`` and the 74 statistics of each record; an empty denominator gives 0."""
    counts = token_counts(records, keys, function_list if function_list is not None else function_words())
    total = lambda c: F.sum(c).alias(c)
    of = lambda column, labels, what="_words": F.coalesce(F.sum(F.when(F.col(column).isin(*labels), F.col(what))), F.lit(0))
    sums = [total(c) for c in ("_words", "_signs", "_seen", "_known", "_spelt", "_chars")]
    roles = {("_pos", n): label for n, label in POS_ROLES.items()} | {("_dep", n): label for n, label in DEP_ROLES.items()}
    sums += [of(column, [label]).alias(f"{column}_{n}") for (column, n), label in roles.items()]
    sums += [of("_dep", ["prep"], "_all").alias("_prep"), of("_dep", CLAUSAL, "_all").alias("_clauses")]
    made = counts.groupBy(*keys, "_sentences", "_chunks").agg(*sums)
    made = made.withColumns({f"{column}_matched": sum((F.col(f"{column}_{n}") for c, n in roles if c == column), F.lit(0)) for column in ("_pos", "_dep")})
    made = made.withColumn("_phrases", F.col("_chunks") + F.col("_prep") + F.col("_clauses"))
    parts = {
        "avg_sentence_length_words": ("_words", "_sentences"),
        "avg_function_words_per_sentence": ("_known", "_sentences"),
        "punctuation_rate": ("_signs", "_seen"),
        "avg_word_length": ("_chars", "_spelt"),
        "function_word_rate": ("_known", "_words"),
        **dict(zip(PHRASES, (("_chunks", "_phrases"), ("_prep", "_phrases"), ("_clauses", "_phrases")))),
        **{f"{column[1:]}_{n}_rate": (f"{column}_{n}", f"{column}_matched") for column, n in roles},
    }
    return made.select(*keys, *(safe_rate(F.col(a), F.col(b), digits).alias(name) for name, (a, b) in parts.items()))


def statistics_summary(stats: DataFrame) -> DataFrame:
    """Mean of the basic features for each split and side; absent columns are left out."""
    return stats.groupBy("split", "side").agg(*(F.bround(F.avg(c), 6).alias(f"mean_{c}") for c in BASIC if c in stats.columns))
