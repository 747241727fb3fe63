"""Mixing documents to target token weights by iterative proportional fitting.

Topics are learnt from every text with a word: TF-IDF vectors, hashed to
``WIDTH`` signed numbers and less the mean of their language, are clustered by
cosine, and every text gets the topic of its nearest centroid.  Each round of
the clustering is one pass over what was written of the vectors, set apart from
their languages.  Sums and products are of whole numbers, so no order or
partitioning of the rows changes a topic.

Tokens are summed by cell (source, language, topic).  Raking multiplies the
cells' keep rates so that each margin in turn meets its target, no rate above
one, until all margins hold.  A document is then kept if a uniform number made
from its id lies under the rate of its cell, so the same rows give the same
sample anywhere.

Targets default to tempered shares: a margin's share to a power below one,
which lifts small sources and languages and holds down a hot one.

The cells are few as a rule and raked on the driver, behind a check of their
number; beyond it the same steps run as aggregations and joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from inkprint.llm.common import discard, materialise, sliced, texts, utf8
from inkprint.llm.language import DIMENSIONS, counted, document_frequency

MARGINS = ("source", "lang", "topic")
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Targets:
    """Wanted share of each margin: given, or the present share to the power ``temper``."""

    #: Tokens kept in all, as a share of the tokens there are.
    volume: float = 0.7
    temper: dict[str, float] = field(default_factory=lambda: {"source": 0.7, "lang": 0.8, "topic": 0.8})
    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    sweeps: int = 200
    tolerance: float = 1e-6
    #: Topics, and the most rounds of their clustering.
    topics: int = 12
    rounds: int = 12
    #: A margin's share may miss its target by this much before it counts as not met.
    slack: float = 0.005
    #: More cells than this are raked by aggregations.
    local_cells: int = 200_000


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Languages with a mean of their own; texts of any other are compared with the mean of all.
OWN_MEANS = 32
#: Numbers of a text's vector, and what stands for 1.0 in it and in a centroid; products of both are exact in float64.
WIDTH = 512
ONE, FINE = 1 << 12, 1 << 20
#: Starts drawn in one pass.
DRAWN = 4
_BUCKETS, _SIGNS = np.empty(DIMENSIONS, np.int64), np.empty(DIMENSIONS)
_ORDER = np.random.default_rng(7).permutation(DIMENSIONS)
_BUCKETS[_ORDER] = np.arange(DIMENSIONS) // (DIMENSIONS // WIDTH)
_SIGNS[_ORDER] = np.random.default_rng(8).choice(np.array([-1, 1]), DIMENSIONS)


def hashed(text: bytes, idf: np.ndarray) -> np.ndarray:
    """The TF-IDF vector of one text hashed to WIDTH numbers, with signs, so that products keep their expected values.

    Only the trigrams it has are weighted, not all DIMENSIONS.
    """
    hit, n = counted(text)
    weight = (1 + np.log(n)) * idf[hit]
    size = max(float(np.sqrt((weight * weight).sum())), 1e-12)
    return np.rint(np.bincount(_BUCKETS[hit], weight * _SIGNS[hit], WIDTH) * (ONE / size)).astype(np.int16)


def _held(column: pa.Array) -> np.ndarray:
    """The vectors of a binary column, one a row, as float64."""
    return utf8(column)[0].view(np.int16).reshape(-1, WIDTH).astype(np.float64)


@dataclass(frozen=True)
class Topics:
    """Mean vector of each of the larger languages, of all (in the last row), and the topics' centroids."""

    langs: dict[str, int]
    means: np.ndarray
    centres: np.ndarray

    def apart(self, column: pa.Array, langs: pa.Array) -> np.ndarray:
        """What sets each text apart from its language, as whole numbers of length ONE, so that topics don't repeat the languages; 0 if nothing does."""
        of = [self.langs.get(x, len(self.langs)) for x in langs.to_pylist()]
        rows = _held(column) - self.means[of]
        size = np.sqrt((rows * rows).sum(axis=1))
        return np.rint(rows * np.where(size < 1, 0, ONE / np.maximum(size, 1))[:, None])

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and cosine of each row's nearest centroid; of equally near ones the first."""
        found = rows @ self.centres.T
        return np.argmax(found, axis=1), found.max(axis=1) / (ONE * FINE)


def _unit(row: np.ndarray) -> np.ndarray:
    return np.rint(row * (FINE / max(float(np.sqrt((row * row).sum())), 1e-12)))


def _pass(rows: DataFrame, run: Callable, kinds: str) -> DataFrame:
    """``run`` over ``rows``, with what each of a few tasks a core makes."""
    return rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, kinds)


def _sums(rows: DataFrame, parts: int, part_of: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the vectors (the first column) and count of the rows of each part; ``part_of`` gives each row's part from a batch and its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, WIDTH + 1), np.int64)
        for batch in sliced(batches):
            vector = _held(batch.column(0))
            member = (np.arange(parts)[:, None] == part_of(batch, vector)).astype(np.float64)
            total[:, :WIDTH] += (member @ vector).astype(np.int64)  # whole numbers far under 2^53
            total[:, WIDTH] += member.sum(axis=1).astype(np.int64)
        flat = total.ravel()
        hit = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(flat[hit])], ["slot", "n"])

    out = np.zeros(parts * (WIDTH + 1))
    for slot, n in _pass(rows, run, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():  # at most parts * (WIDTH + 1) rows
        out[slot] = n
    out = out.reshape(parts, -1)
    return out[:, :WIDTH], out[:, WIDTH]


def _set_apart(rows: DataFrame, topics: Topics) -> DataFrame:
    """Chance and ``Topics.apart`` of each row; written, as every start and round reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [v.tobytes() for v in topics.apart(batch.column(0), batch.column(1)).astype(np.int16)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(2)], ["vector", "chance"])

    return materialise(rows.select("vector", "lang", "chance").mapInArrow(run, "vector binary, chance double"), "apart")


def _starts(apart: DataFrame, topics: Topics, count: int) -> list[np.ndarray]:
    """At most ``count`` different rows drawn by their chance, weighted by the distance from the centroids there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            vector = _held(batch.column(0))
            far = 1 - topics.nearest(vector)[1] if len(topics.centres) else np.ones(len(vector))
            late = np.where((far < 1e-3) | ~vector.any(axis=1), np.inf, -np.log(batch.column(1).to_numpy()) / np.maximum(far, 1e-9))
            # the first ``count``, and what is level with the last of them
            last = np.sort(late)[:count][-1]
            best = sorted((late[i], batch.column(0)[i].as_py()) for i in np.flatnonzero((late <= last) & np.isfinite(late)))[:count]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in best], pa.float64()), pa.array([v for _, v in best], pa.binary())], ["late", "vector"])

    found = _pass(apart.select("vector", "chance"), run, "late double, vector binary").orderBy("late", "vector").limit(count).collect()
    return [_unit(np.frombuffer(x, np.int16).astype(np.float64)) for x in dict.fromkeys(bytes(r["vector"]) for r in found)]


def learn_topics(rows: DataFrame, targets: Targets) -> Topics:
    """Topics of ``rows`` (see ``vectors_of``), learnt from all that have a word.

    Spherical k-means: starts are drawn one after another, farther rows with a
    higher chance; then come rounds until no centroid moves, at most
    ``targets.rounds``.
    """
    known = rows.where("n_tokens > 0")
    names = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(OWN_MEANS).collect()]
    langs = {x: i for i, x in enumerate(names)}

    def by_lang(batch: pa.RecordBatch, vector: np.ndarray) -> np.ndarray:
        return np.array([langs.get(x, len(langs)) for x in batch.column(1).to_pylist()])

    total, n = _sums(known.select("vector", "lang"), len(langs) + 1, by_lang)
    total[-1], n[-1] = total.sum(axis=0), n.sum()
    means, centres = total / np.maximum(n, 1)[:, None], np.zeros((0, WIDTH))
    if not n[-1]:
        return Topics(langs, means, centres)
    apart = _set_apart(known, Topics(langs, means, centres))
    while len(centres) < targets.topics:
        more = _starts(apart, Topics(langs, means, centres), min(DRAWN, targets.topics - len(centres)))
        if not more:
            break
        centres = np.array([*centres, *more])
    for _ in range(targets.rounds if len(centres) else 0):
        now = Topics(langs, means, centres)
        total, n = _sums(apart.select("vector"), len(centres), lambda batch, vector, now=now: now.nearest(vector)[0])
        new = np.array([_unit(t) if k else c for t, k, c in zip(total, n, centres)])
        if (new == centres).all():
            break
        centres = new
    discard(apart)
    return Topics(langs, means, centres)


def margins() -> dict[str, Column]:
    """The margins that are columns, as text; null is a value of its own."""
    return {m: F.coalesce(F.col(m).cast("string"), F.lit(UNKNOWN)) for m in ("source", "lang")}


def vectors_of(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """u (see ``uniform``), source, lang, chance (a number above 0, made from doc_id and text), ``row`` (doc_id, if none is given), n_tokens and vector of each row; written."""
    n, df = document_frequency(docs.where("text is not null"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made, sizes = [], []
            for text in texts(batch.column(0)):
                made.append(hashed(text, idf).tobytes())
                sizes.append(len(text.split()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], [*batch.schema.names[1:], "n_tokens", "vector"])

    chance = (F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 52)) + 1).cast("double") / float((1 << 52) + 1)
    read = docs.select("text", uniform(71).alias("u"), *(c.alias(m) for m, c in margins().items()), chance.alias("chance"), (F.col("doc_id") if row is None else row).alias("row"))
    kinds = StructType([*read.schema.fields[1:], StructField("n_tokens", LongType()), StructField("vector", BinaryType())])
    return materialise(read.mapInArrow(run, kinds), "vectors")


def cells_of(docs: DataFrame, targets: Targets, row: Column | None = None) -> DataFrame:
    """u (see ``uniform``), the three margins, n_tokens and ``row`` (doc_id, if none is given) of each row; written.

    A topic is named t00, t01, ...; a text without a word, or the only kind of
    texts there are, is of the topic ``unknown``.
    """
    rows = vectors_of(docs, row)
    sent = docs.sparkSession.sparkContext.broadcast(learn_topics(rows, targets))  # OWN_MEANS + 1 + topics vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = sent.value
        for batch in sliced(batches):
            vector = learnt.apart(batch.column(0), batch.column(3))
            best = learnt.nearest(vector)[0].tolist() if len(learnt.centres) else [0] * len(vector)
            topics = [f"t{at:02d}" if size and len(learnt.centres) else UNKNOWN for at, size in zip(best, batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:5], pa.array(topics, pa.string()), batch.column(5)], [*batch.schema.names[1:5], "topic", "n_tokens"])

    read = rows.select("vector", "u", "source", "lang", "row", "n_tokens")
    kinds = StructType([*read.schema.fields[1:5], StructField("topic", StringType()), StructField("n_tokens", LongType())])
    made = materialise(read.mapInArrow(run, kinds), "cells-of-rows")
    discard(rows)
    return made


def _wanted(present: dict[str, float], margin: str, targets: Targets) -> dict[str, float]:
    total = sum(present.values())
    raw = targets.shares.get(margin) or {k: (v / total) ** targets.temper[margin] for k, v in present.items() if v > 0}
    norm = sum(raw.get(k, 0.0) for k in present) or 1.0
    return {k: targets.volume * total * raw.get(k, 0.0) / norm for k in present}


def rake(keys: list[tuple[str, str, str]], tokens: np.ndarray, targets: Targets = Targets()) -> np.ndarray:
    """Keep rate of each cell, 0 to 1.

    Margins that no rates of at most one can meet come as near as the sweeps
    get.  A cell without tokens keeps ``volume``.
    """
    rate = np.full(len(keys), targets.volume)
    if not tokens.sum():
        return rate
    plans = []
    for at, margin in enumerate(MARGINS):
        values, of = np.unique([k[at] for k in keys], return_inverse=True)
        wanted = _wanted(dict(zip(values.tolist(), np.bincount(of, tokens).tolist())), margin, targets)
        plans.append((of, np.array([wanted[v] for v in values])))
    for _ in range(targets.sweeps):
        before = rate.copy()
        for of, wanted in plans:
            now = np.bincount(of, rate * tokens)
            rate = np.minimum(1.0, rate * np.where(now > 0, wanted / np.maximum(now, 1e-300), 1.0)[of])
        if np.abs(rate - before).max() < targets.tolerance:
            break
    return rate


def rake_table(cells: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """The same for a table of cells (source, lang, topic, tokens) of any size: adds ``rate``."""
    now = materialise(cells.withColumn("rate", F.lit(targets.volume)), "cells")
    total = now.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return now
    aims = {}
    for margin in MARGINS:
        present = now.groupBy(margin).agg(F.sum("tokens").alias("t"))
        raw = F.pow(F.col("t") / total, F.lit(targets.temper[margin]))
        if given := targets.shares.get(margin):
            raw = F.coalesce(F.create_map(*(F.lit(x) for kv in given.items() for x in kv))[F.col(margin)], F.lit(0.0))
        raw = present.where("t > 0").select(margin, raw.alias("raw"))
        norm = raw.agg(F.sum("raw")).first()[0] or 1.0
        aims[margin] = materialise(raw.select(margin, (F.col("raw") * (targets.volume * total / norm)).alias("aim")), "aims")
    for _ in range(targets.sweeps):
        new = now.withColumn("was", F.col("rate"))
        for margin in MARGINS:
            have = new.groupBy(margin).agg(F.sum(F.col("rate") * F.col("tokens")).alias("have")).join(aims[margin], margin)
            factor = have.select(margin, F.when(F.col("have") > 0, F.col("aim") / F.col("have")).otherwise(1.0).alias("factor"))
            new = new.join(factor, margin, "left").withColumn("rate", F.least(F.lit(1.0), F.col("rate") * F.coalesce("factor", F.lit(1.0)))).drop("factor")
        new = materialise(new, "cells")
        moved = new.agg(F.max(F.abs(F.col("rate") - F.col("was")))).first()[0]
        now = new.drop("was")
        if moved < targets.tolerance:
            break
    return now


def rates(rows: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """(source, lang, topic, tokens, rate) for rows of ``cells_of``; marked for broadcast where its size was checked."""
    cells = materialise(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    if cells.count() > targets.local_cells:
        return rake_table(cells, targets).select(*MARGINS, "tokens", "rate")
    found = sorted(cells.collect())
    rate = rake([tuple(r[:3]) for r in found], np.array([r[3] for r in found], np.float64), targets)
    table = rows.sparkSession.createDataFrame([(*r[:4], float(x)) for r, x in zip(found, rate)], "source string, lang string, topic string, tokens long, rate double")
    return F.broadcast(table)


def report(cells: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """How near the rates come to what was wanted, from rows of ``rates``.

    Returns margin, value, tokens, target and expected (both shares of the kept
    tokens), residual (expected - target), met (within ``targets.slack``) and
    capped (tokens of the value that are kept whole, as a share of its tokens).
    A target is out of reach where all of a value's tokens together are fewer
    than it asks for: capped is 1 and met false.
    """
    out = None
    total = cells.agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("rate")).alias("k")).first()
    for margin in MARGINS:
        per = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("rate")).alias("kept"), F.sum(F.when(F.col("rate") >= 1, F.col("tokens")).otherwise(0)).alias("whole"))
        raw = F.pow(F.col("tokens") / F.lit(float(total["t"] or 1)), F.lit(targets.temper[margin]))
        if given := targets.shares.get(margin):
            raw = F.coalesce(F.create_map(*(F.lit(x) for kv in given.items() for x in kv))[F.col("value")], F.lit(0.0))
        per = per.where("tokens > 0").withColumn("raw", raw)
        norm = per.agg(F.sum("raw")).first()[0] or 1.0
        rows = per.select(F.lit(margin).alias("margin"), "value", "tokens", (F.col("raw") / norm).alias("target"), (F.col("kept") / F.lit(float(total["k"] or 1))).alias("expected"), (F.col("whole") / F.col("tokens")).alias("capped"))
        out = rows if out is None else out.unionByName(rows)
    missed = F.col("expected") - F.col("target")
    return out.withColumn("residual", missed).withColumn("met", F.abs(missed) <= targets.slack)


def uniform(seed: int) -> Column:
    """A number in [0, 1) made from doc_id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)).cast("double") / float(1 << 52)


def mix(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source, lang) with its cell, keep rate and decision.

    Returns doc_id, source, lang, topic, n_tokens, rate, kept, and for each
    margin its target share and the share expected of the sample, so that a
    target which can't be met shows (``report`` has them as a table).  Null
    source and language count as ``unknown``; a null or blank text has that topic
    and no tokens; very long texts count whole.  Rows of one doc_id get one
    number.  An empty table gives an empty result; other columns, whatever their
    names, are ignored.
    """
    rows = cells_of(docs, targets)
    cells = rates(rows, targets)
    made = rows.join(cells.drop("tokens"), list(MARGINS))
    told = materialise(report(cells, targets).select("margin", "value", "target", "expected"), "report")
    few = told.count() <= targets.local_cells
    for margin in MARGINS:
        own = told.where(F.col("margin") == margin).select(F.col("value").alias(margin), F.col("target").alias(f"{margin}_target"), F.col("expected").alias(f"{margin}_expected"))
        made = made.join(F.broadcast(own) if few else own, margin, "left")
    shares = [f"{m}_{s}" for m in MARGINS for s in ("target", "expected")]
    return made.select(F.col("row").alias("doc_id"), *MARGINS, "n_tokens", "rate", (F.col("u") < F.col("rate")).alias("kept"), *shares)


def sample(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with all their columns.

    Nulls, blank and very long texts, repeated rows and empty tables are as in
    ``mix``.  Every column keeps its value, whatever its name.
    """
    # written once: whether a row is kept then can't differ between the counts and the sample
    rows = cells_of(docs, targets, F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    return rows.join(rates(rows, targets).drop("tokens"), list(MARGINS)).where("u < rate").select("row.*")
