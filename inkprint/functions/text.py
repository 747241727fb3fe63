"""Text normalisation as Column functions; the order of ``normalize`` is part of its meaning."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkprint.functions.lexicon import GREEK

try:
    from ftfy import fix_text
except ImportError:  # mojibake repair is optional
    fix_text = None

#: White space as Python's str.split() and str.strip() see it.
SPACE = r"[\s\x1c-\x1f]"
# fixed values: patterns
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
INLINE_SPACE = r"(?U)[^\S\r\n]+"
AROUND_NEWLINE = r"[ \t]*\n[ \t]*"
MANY_NEWLINES = r"\n{3,}"
QUOTES_FROM, QUOTES_TO = "‘’“”–—− ", "''\"\"--- "
MATH = r"(?s)(?<!\\)\$\$(.+?)(?<!\\)\$\$|(?<!\\)\$(.+?)(?<!\\)\$|\\\((.+?)\\\)|\\\[(.+?)\\\]"
_SYMBOL = r"(?U)^(?:\$\$|\$|\\\(|\\\[)\s*\\([A-Za-z]+)\s*(?:\$\$|\$|\\\)|\\\])$"


def words(text: Column) -> Column:
    """Whitespace-delimited words, as Python's str.split() gives them."""
    return F.filter(F.split(text, f"(?U){SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def coerce(text: Column) -> Column:
    """Null becomes the empty string, anything else a string."""
    return F.coalesce(text.cast("string"), F.lit(""))


def unify_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def plain_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES_FROM, QUOTES_TO)


def math_spans(text: Column, placeholder: str = "<MATH>") -> Column:
    """LaTeX spans: a single known symbol becomes its name, anything else the placeholder.

    One left-to-right pass: the stretches between matches and the matches'
    replacements are zipped together again.
    """
    names = F.create_map(*(F.lit(x) for name in GREEK for x in (name, name.removeprefix("var").lower())))
    found = F.regexp_extract_all(text, F.lit(MATH), F.lit(0))
    replaced = F.transform(found, lambda m: F.coalesce(F.try_element_at(names, F.regexp_extract(m, _SYMBOL, 1)), F.lit(placeholder)))
    pieces = F.zip_with(F.split(text, MATH, -1), replaced, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(pieces, "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, INLINE_SPACE, " ")


def trim_newlines(text: Column) -> Column:
    return F.regexp_replace(text, AROUND_NEWLINE, "\n")


def cap_newlines(text: Column) -> Column:
    return F.regexp_replace(text, MANY_NEWLINES, "\n\n\n")


def repair(form: str = "NFC"):
    """HTML entities, mojibake (where the library for it is there) and Unicode form, in one Arrow pass."""

    @F.pandas_udf("string")
    def fixed(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            text = html.unescape(text)
            if fix_text is not None:
                text = fix_text(text)
            return unicodedata.normalize(form, text)

        return texts.map(one)

    return fixed


def tidy(text: Column) -> Column:
    """The native steps, after ``repair``."""
    for step in (unify_lines, strip_control, plain_quotes, math_spans, collapse_spaces, trim_newlines, cap_newlines, strip):
        text = step(text)
    return text


def normalize(text: Column, form: str = "NFC") -> Column:
    return tidy(repair(form)(coerce(text)))


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding of the decimal form."""
    return F.bround(value, digits)


def safe_rate(count: Column, total: Column, digits: int | None = 3) -> Column:
    """count / total, 0 for an empty total."""
    rate = F.coalesce(F.try_divide(count.cast("double"), total.cast("double")), F.lit(0.0))
    return rate if digits is None else F.bround(rate, digits)
