"""Linguistic records: tokens with part of speech and role, sentences, noun chunks, entities.

A record is tokens array<struct<text,lower,lemma,pos,dep,is_punct,is_space>>,
sentences and chunks array<struct<start,end>> (half-open token ranges), and
ents array<struct<start,end,label>> (character ranges).

``records`` is the backend that needs no model: word lists and endings, asked
once for each different token of a few rows.  ``model_records`` fills the same
schema from a model.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.lexicon import ENTITY_PLACEHOLDERS
from inkprint.functions.text import coerce
from inkprint.operators import sparse

TOKEN = "struct<text:string,lower:string,lemma:string,pos:string,dep:string,is_punct:boolean,is_space:boolean>"
SPAN = "struct<start:int,end:int>"
ENTITY = "struct<start:int,end:int,label:string>"
RECORD = f"tokens array<{TOKEN}>, sentences array<{SPAN}>, chunks array<{SPAN}>, ents array<{ENTITY}>"

#: Placeholders stay whole; words keep inner apostrophes; anything else is one sign.
TOKEN_PATTERN = r"<[A-Z_]+>|\p{L}+(?:['’]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*|[^\s\p{L}\p{N}]"
CLASSES = {
    "DET": "the a an this that these those each every some any no all both",
    "PRON": "i you he she it we they me him her us them my your his its our their who whom whose which what myself himself herself itself ourselves themselves",
    "ADP": "of in to for on with at by from about as into like through after over between out against during without before under around among",
    "CCONJ": "and or but nor yet so",
    "SCONJ": "if because although while since unless whereas though whether",
    "AUX": "is are was were be been being am has have had do does did will would can could shall should may might must",
    "PART": "not n't",
    "VERB": "go goes went make makes made say says said see sees saw know knows knew take takes took get gets got come comes came think thinks thought want wants give gives gave find finds found tell tells told run runs ran keep keeps kept let lets put puts seem seems feel feels felt become becomes became leave leaves left",
}
ENDINGS = {"ADV": "ly", "VERB": "ing ed ize ise", "ADJ": "ous ful ive able ible al ic less"}


_TAGS = {word: tag for tag, words in reversed(CLASSES.items()) for word in words.split()}
_PLACEHOLDER = re.compile("<[A-Z_]+>")
_ENDINGS = {tag: tuple(endings.split()) for tag, endings in ENDINGS.items()}


_ANY_ENDING = tuple(x for endings in _ENDINGS.values() for x in endings)


def _pos(text: str, lower: str) -> str:
    kind = unicodedata.category(text[0])
    if kind[0] != "L":
        if kind[0] == "N":
            return "NUM"
        return "X" if _PLACEHOLDER.fullmatch(text) else "PUNCT" if kind[0] == "P" else "SYM"
    if lower in _TAGS:
        return _TAGS[lower]
    if kind == "Lu" and unicodedata.category(text[1:2] or " ") == "Ll":
        return "PROPN"
    if lower.endswith(_ANY_ENDING):
        for tag, endings in _ENDINGS.items():
            for ending in endings:
                stem = lower[: -len(ending)][-3:]
                if lower.endswith(ending) and len(stem) == 3 and all(unicodedata.category(x)[0] == "L" for x in stem):
                    return tag
    return "NOUN"


def _lemma(lower: str, pos: str) -> str:
    if pos == "VERB" and lower.endswith(("ing", "ed")):
        return lower[: -3 if lower.endswith("ing") else -2]
    return lower[:-1] if pos in ("NOUN", "VERB") and len(lower) > 1 and lower[-1] == "s" != lower[-2] else lower


#: Roles by part of speech alone: all that rules without a parse can tell.
DEPS = {
    "DET": "det", "ADP": "prep", "CCONJ": "cc", "SCONJ": "mark", "AUX": "aux", "PART": "neg", "ADJ": "amod", "ADV": "advmod", "NUM": "nummod", "PUNCT": "punct",
    "VERB": "ROOT", "NOUN": "dobj", "PROPN": "compound", "PRON": "nsubj", "X": "dep", "SYM": "dep",
}


@lru_cache(maxsize=200_000)
def _tagged(text: str) -> tuple[str, str, str, str]:
    """Lower case, lemma, part of speech and role of a token, which its text alone decides."""
    lower = text.lower()
    pos = _pos(text, lower)
    return lower, _lemma(lower, pos), pos, DEPS.get(pos, "dep")


def empty_record() -> dict[str, Column]:
    """The columns of a record without tokens."""
    return {f.split(" ")[0]: F.array().cast(f.split(" ", 1)[1]) for f in ("tokens array<" + TOKEN + ">", f"sentences array<{SPAN}>", f"chunks array<{SPAN}>", f"ents array<{ENTITY}>")}


def _record_columns(found: pa.ListArray) -> pa.StructArray:
    """Records of the token texts of each row: each different text is tagged once, and all its places take what it got."""
    sizes = sparse.sizes_of(found)
    texts = found.flatten().dictionary_encode()
    at = texts.indices
    lower, lemma, pos, dep = [pa.array(column, pa.string()) for column in zip(*map(_tagged, texts.dictionary.to_pylist()))] or [pa.array([], pa.string())] * 4
    among = lambda column, *values: pc.is_in(column, pa.array(values)).to_numpy(zero_copy_only=False)[at.to_numpy()]
    fields = [t.take(at) for t in (texts.dictionary, lower, lemma, pos, dep)] + [pa.array(among(pos, "PUNCT")), pa.array(np.zeros(len(at), bool))]
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
    last = place == sizes[row] - 1

    def spans(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.ListArray:
        made = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
        return sparse.lists_of(np.bincount(rows, minlength=len(sizes)), made)

    closes = np.flatnonzero(last | among(texts.dictionary, ".", "!", "?"))
    end = place[closes] + 1
    start = np.concatenate(([0], end[:-1])) * np.concatenate(([0], row[closes][1:] == row[closes][:-1])) if len(end) else end
    named = among(pos, "NOUN", "PROPN")
    head = np.flatnonzero((named | among(pos, "PRON")) & (last | ~np.concatenate((named[1:], [False]))[: len(named)]))
    listed = sparse.lists_of(sizes, pa.StructArray.from_arrays(fields, ["text", "lower", "lemma", "pos", "dep", "is_punct", "is_space"]))
    return pa.StructArray.from_arrays([listed, spans(row[closes], start, end), spans(row[head], place[head], place[head] + 1)], ["tokens", "sentences", "chunks"])


def records(df: DataFrame, text: str = "text") -> DataFrame:
    """Add tokens, sentences, chunks and ents to each row, by rules; a null or blank text gets an empty record."""
    found = F.regexp_extract_all(coerce(F.col(text)), F.lit(TOKEN_PATTERN), F.lit(0))
    made = sparse.by_rows(_record_columns, f"struct<tokens:array<{TOKEN}>,sentences:array<{SPAN}>,chunks:array<{SPAN}>>")
    staged = df.withColumn("_record", made(found))
    return staged.withColumns({**{c: F.col("_record")[c] for c in ("tokens", "sentences", "chunks")}, "ents": empty_record()["ents"]}).drop("_record")


@lru_cache(maxsize=1)
def load_spacy(model: str = "en_core_web_lg", gpu: bool = False, disabled: tuple[str, ...] = ()):
    """A model of that library, once a worker; with ``gpu`` it is used if there is one."""
    import spacy

    if gpu:
        spacy.prefer_gpu()
    return spacy.load(model, disable=list(disabled))


def _record(doc) -> dict:
    try:
        chunks = [{"start": c.start, "end": c.end} for c in doc.noun_chunks]
    except NotImplementedError:
        chunks = []
    return {
        "tokens": [{"text": t.text, "lower": t.lower_, "lemma": t.lemma_, "pos": t.pos_, "dep": t.dep_, "is_punct": t.is_punct, "is_space": t.is_space} for t in doc],
        "sentences": [{"start": s.start, "end": s.end} for s in doc.sents],
        "chunks": chunks,
        "ents": [{"start": e.start_char, "end": e.end_char, "label": e.label_} for e in doc.ents],
    }


def model_records(df: DataFrame, load: Callable = load_spacy, batch: int = 150, text: str = "text") -> DataFrame:
    """The columns of ``records`` from a model; ``load`` makes it on a worker, and ``pipe(texts, batch_size=...)`` of it gives parsed texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nlp = load()
        for frame in frames:
            rows = [_record(doc) for doc in nlp.pipe(frame[text].fillna("").tolist(), batch_size=batch)]
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(rows, columns=["tokens", "sentences", "chunks", "ents"])], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kept}, {RECORD}")


def entity_table() -> Column:
    return F.create_map(*(F.lit(x) for kv in ENTITY_PLACEHOLDERS.items() for x in kv))


def entity_mask(text: Column, ents: Column) -> Column:
    """Replace each entity span by its placeholder, in order of start; spans that overlap an earlier one are skipped."""
    table = entity_table()
    known = F.filter(ents, lambda e: F.map_contains_key(table, e["label"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, e: F.when(e["start"] < acc["at"], acc).otherwise(
        F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), table[e["label"]]).alias("out"), e["end"].alias("at"))
    )
    spliced = F.aggregate(F.array_sort(known), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(ents.isNull(), text).otherwise(spliced)


def entity_counts(df: DataFrame, by: str = "split") -> DataFrame:
    """Entities of each label and split over all rows and sides, skipped spans included."""
    return df.select(by, F.explode("ents").alias("e")).where(F.map_contains_key(entity_table(), F.col("e.label"))).groupBy(by, F.col("e.label").alias("label")).agg(F.count("*").alias("n"))


def entity_summary(df: DataFrame, by: str = "split") -> DataFrame:
    """One row a split: its rows, and a count for each label, 0 where it is missing."""
    per = F.explode_outer("ents").alias("e")
    counts = [F.count_if(F.col("e.label") == label).alias(f"{label}_count") for label in ENTITY_PLACEHOLDERS]
    rows = df.groupBy(by).agg(F.count_distinct("pair_id").alias("num_rows"))
    return df.select(by, per).groupBy(by).agg(*counts).join(rows, by).select(by, "num_rows", *(f"{label}_count" for label in ENTITY_PLACEHOLDERS))
