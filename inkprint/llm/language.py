"""Language identification by nearest centroid over TF-IDF vectors of byte trigrams.

Texts are lower-cased, everything but letters becomes a blank, and the trigrams
of the whole text are hashed.  Counts are damped, weighted by inverse document
frequency over all training documents, and normalised.  Each language has
several centroids, clustered by cosine from a bounded sample of its training
documents.  A text gets the language of the nearest centroid; it is marked
rejected if it lies farther from it than nearly all of the centroid's members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import materialise, texts

DIMENSIONS = 1 << 14
#: Training documents a language has in the clustering sample, about.
SAMPLE = 400
CENTROIDS = 4
#: Members farther from their centroid than this share of them shape no distance limit.
STRAY = 0.005
#: Languages whose centroids are held at once; with more, texts are compared block by block.
BLOCK = 256
#: Sizes of groups are broadcast up to so many groups, and joined by a shuffle beyond.
BROADCAST_ROWS = 10_000
_ROWS, _BYTES = 64, 1 << 20
_LETTER = regex.compile(r"\p{L}")
_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def _lowered(text: bytes) -> np.ndarray:
    raw = (" " + text.decode().lower() + " ").encode()
    return _BLANKED[np.frombuffer(raw, np.uint8)]


def _codes(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.uint32)
    x = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """Numbers of a text's trigrams; a long text comes piece by piece."""
    data = _lowered(text)
    for at in range(0, len(data) - 2, _BYTES):
        yield _codes(data[at : at + _BYTES + 2])


def counts(batch: list[bytes]) -> np.ndarray:
    """Trigram counts (texts x DIMENSIONS)."""
    out = np.zeros((len(batch), DIMENSIONS), np.float32)
    for row, text in enumerate(batch):
        for codes in _pieces(text):
            out[row] += np.bincount(codes, minlength=DIMENSIONS)
    return out


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of one text, and how often each occurs."""
    found = sum((np.bincount(codes, minlength=DIMENSIONS) for codes in _pieces(text)), np.zeros(DIMENSIONS, np.int64))
    hit = np.flatnonzero(found)
    return hit, found[hit]


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    out = np.zeros_like(found)
    hit = np.nonzero(found)
    out[hit] = (1 + np.log(found[hit])) * idf[hit[1]]
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


def groups(items: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for item in items:
        held.append(item)
        size += len(item)
        if len(held) == _ROWS or size > _BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts: centroids, and each one's distance limit as a least cosine."""
    unit = lambda x: x / max(float(np.linalg.norm(x)), 1e-12)
    chosen = [unit(rows.mean(axis=0))]
    while len(chosen) < min(k, len(rows)):
        chosen.append(rows[int(np.argmin(np.max(rows @ np.array(chosen).T, axis=1)))])
    centre = np.array(chosen)
    for _ in range(rounds):
        own = np.argmax(rows @ centre.T, axis=1)
        centre = np.array([unit(rows[own == j].sum(axis=0)) if (own == j).any() else centre[j] for j in range(len(centre))])
    sims = rows @ centre.T
    own = np.argmax(sims, axis=1)
    floor = [float(np.quantile(sims[own == j, j], STRAY)) if (own == j).any() else 1.0 for j in range(len(centre))]
    return centre, np.array(floor)


def document_frequency(train: DataFrame) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                seen = np.zeros(DIMENSIONS, bool)
                for codes in _pieces(text):
                    seen[codes] = True
                df += seen
                n += 1
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(df[hit], n))], ["slot", "df"])

    rows = train.select("text").mapInArrow(run, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df")).toArrow()
    total = dict(zip(rows.column("slot").to_pylist(), rows.column("df").to_pylist()))
    df = np.zeros(DIMENSIONS)
    for slot, n in total.items():
        if slot >= 0:
            df[slot] = n
    return total.get(-1, 0), df


def drawn(docs: DataFrame, by: list[str], sample: int) -> DataFrame:
    """About ``sample`` different texts of each group of ``docs`` (doc_id, text, ...), by hash; equal rows are one.

    Groups are counted by different rows too, so that copies neither fill the
    sample nor empty it.
    """
    marked = docs.select(*by, "doc_id", "text", F.xxhash64("doc_id", "text", F.lit(5)).alias("h"))
    sizes = materialise(marked.groupBy(*by).agg(F.approx_count_distinct("h", 0.02).alias("n")), "sizes")
    u = F.pmod(F.col("h"), F.lit(1 << 20)).cast("double") / (1 << 20)
    if by:
        joined = marked.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, by)
    else:
        joined = marked.withColumn("n", F.lit(sizes.first()["n"]))
    return joined.where(u * F.col("n") < sample).groupBy(*by, "h").agg(F.min("text").alias("text"))


def train(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> tuple[DataFrame, np.ndarray]:
    """(table lang, centre, floor of the centroids, idf) from ``docs`` (doc_id, text, lang) with text and lang."""
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string"))
    n, df = document_frequency(known)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["h", "text"])
        rows = np.concatenate([vectors(counts(g), idf) for g in groups(t.encode() for t in table["text"])])
        centre, floor = cluster(rows, k)
        return pd.DataFrame({"lang": table["lang"].iloc[0], "centre": [c.astype("float32") for c in centre], "floor": floor})

    fitted = drawn(known, ["lang"], sample).groupBy("lang").applyInPandas(fit, "lang string, centre array<float>, floor double")
    return materialise(fitted, "centroids"), idf


def _nearest(names: list[str], centres: np.ndarray, floors: np.ndarray, idf: np.ndarray, batch: list[bytes]) -> list[tuple[str, float, bool]]:
    """(language, cosine, rejected) of the nearest centroid to each text; ``und`` for one without a letter."""
    sims = vectors(counts(batch), idf) @ centres.T
    out = []
    for text, best, row in zip(batch, np.argmax(sims, axis=1).tolist(), sims):
        score = min(1.0, max(0.0, float(row[best])))
        out.append((names[best], score, score < floors[best]) if _LETTER.search(text.decode()) else ("und", 0.0, True))
    return out


def identify(docs: DataFrame, held_out: Column, sample: int = SAMPLE, k: int = CENTROIDS, block: int = BLOCK) -> DataFrame:
    """Predict the language of every text of ``docs`` (doc_id, text, lang), learning where ``held_out`` is false.

    Returns doc_id, held_out, lang_pred, score (cosine), rejected.  ``lang_pred``
    is a learnt language, or ``und`` with score 0 for a null text, a text without
    a letter, and where nothing could be learnt.  Of equally near centroids the
    one of the smaller language wins.  A null ``held_out`` counts as false.  Very
    long texts are counted whole, piece by piece.  Repeated rows are predicted
    each.  Any number of languages can be learnt: the centroids of ``block`` of
    them are held at once.  An empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    table, idf = train(rows.where("not held_out"), sample, k)
    langs = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = ["lang_pred", "score", "rejected"]
    made = rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), "text")
    for at in range(0, len(langs), block):
        some = table.where(F.col("lang").isin(langs[at : at + block])).collect()  # at most block * k vectors
        found = sorted(some, key=lambda r: (r["lang"], r["floor"]))
        names, floors = [r["lang"] for r in found], np.array([r["floor"] for r in found])
        sent = docs.sparkSession.sparkContext.broadcast((names, np.array([r["centre"] for r in found], np.float32), floors, idf))
        kept = ["text"] if at + block < len(langs) else []

        def run(batches: Iterator[pa.RecordBatch], sent=sent, kept=kept) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = []
                for group in groups(texts(batch.column(5))):
                    best += _nearest(*sent.value, group)
                had = zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))
                best = [old if old[0] != "und" and old[1] >= new[1] else new for old, new in zip(had, best)]
                columns = [pa.array(x, t) for x, t in zip(zip(*best) if best else ((), (), ()), (pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, *(batch.column(5) for _ in kept)], ["doc_id", "held_out", *result, *kept])

        made = made.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean" + ", text string" * len(kept))
    return made.select("doc_id", "held_out", *result)
