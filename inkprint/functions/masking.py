"""Entity masking by ordered regular expressions; each rule sees what the one before left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns and their order
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?"
RULES: dict[str, str] = {
    "url": r"(?iU)\b(?:https?://|www\.)\S+\b",
    "email": r"(?iU)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b",
    "date": r"(?iU)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|" + _MONTH + r"\s+\d{1,2}(?:,\s*\d{4})?|\d{1,2}\s+" + _MONTH + r"(?:\s+\d{4})?)\b",
    "time": r"(?iU)\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:a\.?m\.?|p\.?m\.?)?\b",
    "currency": r"(?iU)\b(?:[$€£¥]\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?(?:usd|eur|gbp|jpy|idr|sgd|aud|cad|dollars?|euros?|yen|rupiah))\b",
    "address": r"(?iU)\b\d{1,6}\s+(?:[a-z0-9.\-]+\s+){0,5}(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|way|parkway|pkwy)\b\.?",
    "org_suffix": r"(?iU)\b(?:inc|inc\.|llc|l\.l\.c\.|ltd|ltd\.|corp|corp\.|co|co\.|company|plc|gmbh|s\.a\.|ag)\b",
    "number": r"(?U)\b\d+(?:[.,:/-]\d+)*\b",
}


def placeholder(rule: str) -> str:
    return f"<{rule.upper()}>"


#: What edges, white space and other characters are to engines that know ASCII only; ``\w`` is ASCII here, ``\b`` isn't.
_ASCII = {r"\b": r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))", r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]"}


def pattern(rule: str, ascii: bool = False) -> str:
    """A rule's pattern; word edges, digits and white space follow Unicode, as in Python, unless ``ascii``."""
    if not ascii:
        return RULES[rule]
    out = RULES[rule].replace("(?iU)", "(?iu)").replace("(?U)", "")
    for sign, meant in _ASCII.items():
        out = out.replace(sign, meant)
    return out


def beyond_ascii(text: Column) -> Column:
    """Whether ``ascii`` can make a difference: elsewhere both patterns match alike, and the plain one is twice as fast."""
    return text.rlike(r"[^\x00-\x7f]|\x0b")


def _either(odd: Column | None, made) -> Column:
    return made(False) if odd is None else F.when(odd, made(True)).otherwise(made(False))


def mask(text: Column, rule: str, ascii: bool = False, odd: Column | None = None) -> Column:
    """``odd`` is ``beyond_ascii`` of the text, where it is known already."""
    one = lambda a: F.regexp_replace(text, pattern(rule, a), placeholder(rule))
    return _either((beyond_ascii(text) if odd is None else odd) if ascii else None, one)


def count(text: Column, rule: str, ascii: bool = False, odd: Column | None = None) -> Column:
    one = lambda a: F.regexp_count(text, F.lit(pattern(rule, a)))
    return _either((beyond_ascii(text) if odd is None else odd) if ascii else None, one)


def mask_all(text: Column, ascii: bool = False) -> Column:
    def chain(a: bool) -> Column:
        out = text
        for rule in RULES:
            out = F.regexp_replace(out, pattern(rule, a), placeholder(rule))
        return out

    return _either(beyond_ascii(text) if ascii else None, chain)


def mask_with_counts(df, column: str, prefix: str = "", ascii: bool = False):
    """Add ``{prefix}{rule}_count`` for each rule and replace ``column`` by its masked form; null counts as empty."""
    df = df.withColumn(column, F.coalesce(F.col(column), F.lit("")))
    odd = F.col("_odd") if ascii else None
    df = df.withColumn("_odd", beyond_ascii(F.col(column))) if ascii else df
    for rule in RULES:
        df = df.withColumn(f"{prefix}{rule}_count", count(F.col(column), rule, ascii, odd)).withColumn(column, mask(F.col(column), rule, ascii, odd))
    return df.drop("_odd") if ascii else df


def replacement_counts(pairs, ascii: bool = False):
    """One row a split: its rows, and each rule's replacements over both texts, every rule counted on what those before it left."""
    sided = pairs.select("split", F.explode(F.array(F.struct(F.lit(1).alias("one"), F.col("text1").alias("text")), F.struct(F.lit(0).alias("one"), F.col("text2").alias("text")))).alias("s"))
    counted = mask_with_counts(sided.select("split", "s.one", "s.text"), "text", ascii=ascii)
    return counted.groupBy("split").agg(F.sum("one").alias("num_rows"), *(F.sum(f"{r}_count").alias(f"{r}_count") for r in RULES))
