"""Ordinal quality classifier: a cumulative-link model over hashed text features.

Grades 0 < 1 < ... < G-1 share one weight vector; ordered thresholds cut the
score line into grades: P(grade <= j) = sigmoid(threshold_j - score).  The
expected grade ranks documents, the tail probability of the best grade selects
them.

Features are presences: each word (outer punctuation off), its first four and
five bytes, and the deciles of a few shape measures, all hashed into one table.
The fit uses a bounded sample of the labelled rows, on the driver; scoring
covers every row.  Columns are standardised, and a soft threshold on the
weights drops features that are no more than noise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import RecentCache, sliced, texts, tokens

_OUTER = b".,;:!?\"'()"
_SHAPES = ("distinct", "upper", "symbol", "repeat", "length")


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    #: Labelled rows used for the fit, and features each must keep for a row.
    sample: int = 12_000
    least_documents: int = 15
    steps: int = 250
    penalty: float = 0.004
    #: A document is kept if the best grade is at least this probable.
    tail: float = 0.5


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int
    tail: float
    grades: int = field(init=False)

    def __post_init__(self) -> None:
        self.grades = len(self.thresholds) + 1

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= j) for each score and threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


class Featuriser:
    """Feature numbers of a text; those of recent words are remembered."""

    def __init__(self, bits: int, cache: int = 120_000):
        self.mask = (1 << bits) - 1
        self.words = RecentCache(cache)

    def _slot(self, kind: int, data: bytes) -> int:
        return xxhash.xxh64_intdigest(data, kind) & self.mask

    def _word(self, word: bytes) -> tuple[int, ...]:
        bare = word.strip(_OUTER)
        return (self._slot(1, bare), self._slot(2, bare[:4]), self._slot(3, bare[:5])) if bare else (self._slot(1, word),)

    def features(self, text: bytes) -> np.ndarray:
        """Sorted distinct feature numbers; a blank text has its length shape only."""
        words = tokens(text)
        kinds = set(words)
        out: set[int] = set()
        get, put = self.words.get, self.words.put
        for word in kinds:
            slots = get(word)
            if slots is None:
                slots = self._word(word)
                if len(word) < 256:
                    put(word, slots)
            out.update(slots)
        n, size = max(1, len(words)), max(1, len(text))
        upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        symbols = len(text) - len(text.translate(None, b"#*$%&|<>!"))
        pairs = len(set(zip(words, words[1:])))
        shape = {"distinct": len(kinds) / n, "upper": upper / size, "symbol": min(1.0, 4 * symbols / size), "repeat": 1 - pairs / max(1, len(words) - 1), "length": min(1.0, math.log2(n) / 16)}
        out.update(self._slot(4, f"{name}={int(10 * shape[name])}".encode()) for name in _SHAPES)
        return np.sort(np.fromiter(out, np.int64, len(out)))


def fit(rows: list[np.ndarray], grades: np.ndarray, count: int, settings: Settings) -> Model:
    """Fit by accelerated proximal gradient on standardised presences."""
    size = 1 << settings.bits
    if not len(rows):
        return Model(np.zeros(size), np.linspace(-1, 1, count - 1) - 2.0, settings.bits, settings.tail)
    n = len(rows)
    sizes = np.fromiter(map(len, rows), np.int64, n)
    flat = np.concatenate(rows).astype(np.int32, copy=False)
    df = np.bincount(flat, minlength=size)
    used = np.flatnonzero((df >= settings.least_documents) & (df <= n - settings.least_documents))
    to = np.full(size, -1, np.int32)
    to[used] = np.arange(len(used))
    # the sparse matrix by rows and by columns, as two arrays of numbers; sums run over stretches of them
    col = to[flat]
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)[col >= 0]
    col = col[col >= 0]
    del flat
    by_column = row[np.argsort(col, kind="stable")]
    row_starts = np.flatnonzero(np.diff(row, prepend=-1))
    filled = row[row_starts]
    del row
    column_starts = np.cumsum(df[used]) - df[used]
    share = df[used] / n
    spread = np.sqrt(share * (1 - share))
    centre = share / spread

    def times(w: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(filled):
            out[filled] = np.add.reduceat((w / spread)[col], row_starts)
        return out - centre @ w

    def back(r: np.ndarray) -> np.ndarray:
        return (np.add.reduceat(r[by_column], column_starts) / spread if len(used) else np.zeros(0)) - centre * r.sum()

    w = np.random.default_rng(1).normal(size=len(used)) if len(used) else np.zeros(0)
    top = 1.0
    for _ in range(12 if len(used) else 0):
        w = back(times(w)) / n
        top = float(np.linalg.norm(w)) or 1.0
        w /= top
    step = 1.0 / (0.3 * top + 0.3)
    share_below = np.clip(np.array([(grades <= j).mean() for j in range(count - 1)]), 1e-3, 1 - 1e-3)
    cuts = np.log(share_below / (1 - share_below))
    cuts = np.maximum.accumulate(cuts + np.arange(count - 1) * 1e-3)
    w = np.zeros(len(used))
    look, was_w, was_cuts, speed = w.copy(), w.copy(), cuts.copy(), 1.0
    look_cuts = cuts.copy()
    for _ in range(settings.steps):
        score = times(look)
        edge = np.concatenate(([-np.inf], look_cuts, [np.inf]))
        high, low = edge[grades + 1] - score, edge[grades] - score
        at_high, at_low = 1 / (1 + np.exp(-np.clip(high, -500, 500))), 1 / (1 + np.exp(-np.clip(low, -500, 500)))
        slope_high, slope_low = at_high * (1 - at_high), at_low * (1 - at_low)
        p = np.maximum(at_high - at_low, 1e-9)
        by_score = (slope_high - slope_low) / p / n
        by_cut = np.array([(-(slope_high * (grades == j)) / p + (slope_low * (grades == j + 1)) / p).sum() / n for j in range(count - 1)])
        new = look - step * back(by_score)
        new = np.sign(new) * np.maximum(np.abs(new) - step * settings.penalty, 0)
        new_cuts = np.maximum.accumulate(look_cuts - np.minimum(step, 1.0) * by_cut + np.arange(count - 1) * 1e-6)
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        pull = (speed - 1) / faster
        look, look_cuts = new + pull * (new - was_w), np.maximum.accumulate(new_cuts + pull * (new_cuts - was_cuts))
        was_w, was_cuts, speed = new, new_cuts, faster
    weights = np.zeros(size)
    weights[used] = was_w / spread
    return Model(weights, was_cuts + centre @ was_w, settings.bits, settings.tail)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labelled rows: 0 toxic, 1 poor, 2 good; the worst, if a document is labelled twice."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.where("doc_id is not null").select("doc_id", grade.alias("grade")).where("grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, grades: int, settings: Settings = Settings()) -> Model:
    """Fit on at most about ``settings.sample`` rows of ``docs`` that ``ratings`` (doc_id, grade) covers, drawn by hash.

    A null text is empty; of an id's rows the text of least hash counts; a very
    long text has no more than 2**bits features.  Without a labelled row the
    model keeps nothing apart: equal weights, and cuts that accept any text.
    """
    total = ratings.count()
    share = min(1.0, settings.sample / max(1, total))
    drawn = ratings.where(F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Featuriser(settings.bits)
        for batch in sliced(batches):
            found = [made.features(t).astype(np.int32) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "features"])

    # one text for each id, so that a repeated id can't pass the bound
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(drawn, "doc_id")
    one = met.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("grade").cast("int").alias("grade"))
    rows = one.select("doc_id", "text", "grade").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, features array<int>")
    table = rows.toArrow()
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    features, known = table.column("features").combine_chunks(), table.column("grade").to_numpy().astype(np.int64)[order]
    del table
    flat, ends = features.flatten().to_numpy(), features.offsets.to_numpy() if len(order) else np.zeros(1, np.int64)
    return fit([flat[ends[i] : ends[i + 1]] for i in order.tolist()], known, grades, settings)


def _judge(model: Model) -> Callable[[], Callable]:
    """Makes a worker's judge: texts to (expected grade, tail probability, kept)."""
    used = np.flatnonzero(model.weights)
    slots, values, cuts, bits, tail = used.astype(np.int64), model.weights[used], model.thresholds, model.bits, model.tail

    def make() -> Callable:
        weights = np.zeros(1 << bits)
        weights[slots] = values
        made, table = Featuriser(bits), Model(weights, cuts, bits, tail)

        def judge(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            scores, blank = [], []
            for text in texts(column):
                scores.append(float(weights[made.features(text)].sum()))
                blank.append(not text.strip())
            below = table.below(np.array(scores, np.float64))
            best = 1.0 - below[:, -1]
            return (1.0 - below).sum(axis=1), best, (best >= tail) & ~np.array(blank, bool)

        return judge

    return make


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, tail_probability and kept for every row of ``docs`` (doc_id, text).

    A null or blank text is judged by its length alone and never kept.  Repeated
    rows are judged each.  An empty table gives an empty result; other columns
    are ignored.
    """
    make = _judge(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, judge(batch.column(1)))], ["doc_id", "expected_grade", "tail_probability", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean")


def select(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``rate`` keeps, with all their columns and values.

    Null and blank texts go; repeated rows are judged each; an empty table gives
    an empty one.
    """
    make, at = _judge(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for batch in sliced(batches):
            yield batch.filter(pa.array(judge(batch.column(at))[2]))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on the rows of ``docs`` that ``labels`` (doc_id, quality, toxic) covers, and rate all rows."""
    return rate(docs, train(docs, graded(labels), 3, settings))
