"""Language-model scoring with a weighted backoff automaton over smoothed trigrams.

States are the root, one for each known word as left context (the start of a
text is one of them), and one for each pair of words seen ``STATE`` times or
more.  With h' the state that a failure arc leads to, h less its first word,
state h has an arc for each word w seen after it, with weight
log((c(h,w) + k p(w|h')) / (c(h) + k)), and a failure arc to h' with weight
log(k / (c(h) + k)); the root has an arc with weight log p(w) for every word,
p(w) = (c(w) + 1) / (N + V + 1), and one for the class of unknown words.  All
weights of a state sum to one.  An arc leads to the longest end of what was
read that is a state.  Reading a text left to right, each token starts from the
state that the token before led to; where that has no arc for it, failure arcs
are followed until one has.

k depends on the length of h and on how often it was seen: one value for each
range of c(h), the one under which the training tokens are most probable, each
left out of its own counts.

Neither counts nor automaton are gathered anywhere.  Texts are packed into
chunks as they are read.  Each chunk sends the hashes of its distinct words and
pairs with their counts to buckets; a bucket adds them up and answers every
chunk, in the order asked, with the counts over the whole corpus.  The same
goes for the triples after a pair that is a state, known from the first answer.
So each chunk holds just the part of the automaton that its texts can reach.  A
hot word, pair or triple is one entry a chunk.  With very many buckets the
chunks are answered through blocks of chunks, so that the rows exchanged grow
with the input and not with its square.

Within a bucket hashes are cut to ``KEEP`` bits.  As the number of buckets
follows the input, a false match has the same probability at every size, about
one in 100,000.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkprint.llm.common import materialise, texts, tokens, utf8

#: Pseudo counts tried, and the counts of a context at which another may hold.
PSEUDO = (1.0, 10.0, 100.0, 1e3, 1e4, 1e6)
RANGES = (10, 100, 1000, 100_000)
#: How often a pair of words must be seen to be a state.
STATE = 2
#: Bits kept of a hash within its bucket.
KEEP = 40
#: Text bytes a bucket answers for; buckets are split by so many bits at once.
BUCKET_BYTES, FAN_BITS = 16 << 20, 10
#: Chunks that are answered as one where buckets are split more than once.
BLOCK = 256
_END, _START = np.uint64(xxhash.xxh64_intdigest(b" ", 1)), np.uint64(xxhash.xxh64_intdigest(b"\n", 1))


# ---- coding


def pack(counts: np.ndarray) -> bytes:
    """Counts as one byte each, those of 255 or more in four that follow; compressed."""
    large = counts >= 255
    return zstandard.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<u4").tobytes(), 1)


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    data = zstandard.decompress(data)
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u4", offset=n)
    return counts


def _low_bytes(n: int, bits: int) -> int:
    return max(1, -(-(bits - (16 if n >= 8192 else 8)) // 8))


def encode(values: np.ndarray, bits: int) -> bytes:
    """Ascending values of ``bits`` bits: their upper bits as a bit map, a one for each value and a zero for each step, and whole lower bytes."""
    n = len(values)
    if not n:
        return b""
    low = _low_bytes(n, bits)
    marks = np.zeros(n + (1 << max(0, bits - 8 * low)), np.uint8)
    marks[(values >> np.uint64(8 * low)).astype(np.int64) + np.arange(n)] = 1
    return np.uint32(n).tobytes() + np.packbits(marks).tobytes() + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low]).tobytes()


def decode(data: bytes, bits: int) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    low = _low_bytes(n, bits)
    size = n + (1 << max(0, bits - 8 * low))
    upper = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), 4), count=size)) - np.arange(n)
    lower = np.zeros((n, 8), np.uint8)
    lower[:, :low] = np.frombuffer(data, np.uint8, offset=4 + -(-size // 8)).reshape(n, low)
    return (upper.astype(np.uint64) << np.uint64(8 * low)) | lower.view("<u8").ravel()


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = left * np.uint64(0x9E3779B97F4A7C15) + right
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


# ---- chunks


def _chunked(chunk_bytes: int) -> Callable:
    """Pack rows (doc_id, held_out, text) in the order read into chunks of about ``chunk_bytes`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def out() -> pa.RecordBatch:
            table, sink = pa.Table.from_batches(held), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
                writer.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([base + count], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

        for batch in batches:
            upto = utf8(batch.column(2))[1][1:]
            at = 0
            while at < batch.num_rows:
                done = int(upto[at - 1]) if at else 0
                end = min(batch.num_rows, max(at + 1, int(np.searchsorted(upto, done + chunk_bytes - size, "right"))))
                held.append(batch.slice(at, end - at))
                size += int(upto[end - 1]) - done
                at = end
                if size >= chunk_bytes or at < batch.num_rows:
                    yield out()
                    count, held, size = count + 1, [], 0
        if held:
            yield out()

    return run


class Chunk:
    """The texts of a chunk as token ids, and its distinct words, pairs and triples by hash."""

    def __init__(self, packed: pa.Table):
        self.number = packed.column("chunk")[0].as_py()
        self.table = pa.ipc.open_stream(packed.column("rows")[0].as_py()).read_all()
        vocabulary: dict[bytes, int] = {b" ": 0}
        put = vocabulary.setdefault
        sizes, ids = [], []
        for text in texts(self.table.column("text")):
            words = tokens(text)
            sizes.append(len(words) + 1)
            ids += [put(w, len(vocabulary)) for w in words]
            ids.append(0)
        self.sizes = np.array(sizes, np.int64)
        seq = np.array(ids, np.int32)
        del ids
        self.train = np.repeat(~self.table.column("held_out").to_numpy(), self.sizes)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in vocabulary), np.uint64, len(vocabulary))
        hashes[0] = _END
        self.words, order = np.unique(hashes, return_inverse=True)
        self.seq = order.astype(np.int32)[seq]
        self.end = int(order[0])
        #: Where a text begins; index of the word before each token, or -1 there.
        self.first = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.context = np.concatenate(([-1], self.seq[:-1])).astype(np.int32)
        self.context[self.first] = -1
        left = np.where(self.context < 0, _START, self.words[self.context])
        self.pairs, pair = np.unique(_mixed(left, self.words[self.seq]), return_inverse=True)
        self.pair = pair.astype(np.int32)
        #: Index of the pair before each token, or -1 for the first of a text.
        self.before = np.concatenate(([-1], self.pair[:-1])).astype(np.int32)
        self.before[self.first] = -1

    def triples(self, pair_counts: np.ndarray) -> None:
        """Number the triples after pairs that are states: ``triple`` has each token's, or -1."""
        at = np.flatnonzero((self.before >= 0) & (pair_counts[self.before] >= STATE))
        self.thirds, number = np.unique(_mixed(self.pairs[self.before[at]] ^ _START, self.words[self.seq[at]]), return_inverse=True)
        self.triple = np.full(len(self.seq), -1, np.int32)
        self.triple[at] = number

    def counts(self, of: np.ndarray, size: int) -> np.ndarray:
        """Training tokens with each of ``size`` numbers in ``of``."""
        return np.bincount(of[self.train & (of >= 0)], minlength=size)


# ---- exchange of counts


ASKED = "part long, asker long, a binary, a_counts binary, b binary, b_counts binary, extra binary"
ANSWERED = "part long, asker long, a_counts binary, b_counts binary, extra binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    names = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, pa.int64() if t == "long" else pa.binary()) for (_, t), c in zip(names, zip(*rows) if rows else [()] * len(names))], names=[n for n, _ in names])


def _cut(values: np.ndarray, bits: int, by: int) -> tuple[list[int], np.ndarray]:
    """(where each of 2**by ranges of ascending ``values`` of ``bits`` bits begins, what is left of the values within a range)."""
    edges = np.arange(1, 1 << by, dtype=np.uint64) << np.uint64(bits - by) if by else np.zeros(0, np.uint64)
    cuts = [0, *np.searchsorted(values, edges).tolist(), len(values)]
    return cuts, values & np.uint64((1 << (bits - by)) - 1)


def _asks(asker: int, part: int, keys: list[np.ndarray], counts: list[np.ndarray], bits: int, by: int, keep: int, extra: np.ndarray) -> list[tuple]:
    """Rows that ask 2**by buckets for ``keys``, cut to ``keep`` bits within a bucket; ``extra`` goes to one of them.

    All are asked, also for nothing: what each answers beside counts is added up.
    """
    cut = [_cut(k, bits, by) for k in keys]
    drop, mine = np.uint64(bits - by - keep), asker % (1 << by)
    out = []
    for p in range(1 << by):
        row = [part << by | p, asker]
        for (cuts, left), n in zip(cut, counts):
            at = slice(cuts[p], cuts[p + 1])
            row += [encode(left[at] >> drop, keep), pack(n[at])]
        out.append((*row, extra.tobytes() if p == mine else b""))
    return out


class _Met:
    """What several askers want to know in one bucket."""

    def __init__(self, table: pa.Table, bits: int):
        self.askers = table.column("asker").to_pylist()
        self.part = table.column("part")[0].as_py()
        self.sizes, self.keys, self.counts, self.back = [], [], [], []
        for kind in ("a", "b"):
            held = [decode(k, bits) for k in table.column(kind).to_pylist()]
            sizes = [len(k) for k in held]
            keys, back = np.unique(np.concatenate(held), return_inverse=True)
            counts = np.concatenate([unpack(c, n) for c, n in zip(table.column(f"{kind}_counts").to_pylist(), sizes)])
            self.sizes.append(np.cumsum([0, *sizes]))
            self.keys.append(keys)
            self.counts.append(np.bincount(back, counts, len(keys)).astype(np.int64))
            self.back.append(back.astype(np.int32))
        extra = [np.frombuffer(x, np.float64) for x in table.column("extra").to_pylist() if x]
        self.extra = sum(extra) if extra else np.zeros(0)

    def answer(self, totals: list[np.ndarray], extra: np.ndarray) -> pa.Table:
        """One row an asker: the totals of its keys in its order."""
        rows = []
        for i, asker in enumerate(self.askers):
            a, b = (pack(t[back[s[i] : s[i + 1]]]) for t, back, s in zip(totals, self.back, self.sizes))
            rows.append((self.part, asker, a, b, extra.tobytes()))
        return _rows(ANSWERED, rows)


def _totals(table: pa.Table) -> pa.Table:
    """Add up a bucket: answers, with the tokens and distinct keys of kind a and the sum of what else was sent."""
    met = _Met(table, KEEP)
    return met.answer(met.counts, np.concatenate(([met.counts[0].sum(), (met.counts[0] > 0).sum()], met.extra)))


def _widest(extras: list[bytes]) -> np.ndarray:
    """The sum of vectors of which some are shorter."""
    held = [np.frombuffer(x, np.float64) for x in extras]
    out = np.zeros(max(map(len, held), default=0))
    for x in held:
        out[: len(x)] += x
    return out


def exchange(asks: DataFrame, bits: int, blocks: int) -> DataFrame:
    """Answers to ``asks``, whose keys have KEEP + ``bits`` bits: their bucket is one of 2**bits within ``part``.

    With bits left, the askers of a block are merged into one, which asks the
    next finer buckets in their place and passes the answers on.
    """
    if not bits:
        return asks.groupBy("part").applyInArrow(_totals, ANSWERED)
    by = min(bits, FAN_BITS)
    blocked = asks.withColumn("block", F.pmod(F.xxhash64("asker"), F.lit(blocks)))

    def merge(table: pa.Table) -> pa.Table:
        met = _Met(table, KEEP + bits)
        return _rows(ASKED, _asks(table.column("block")[0].as_py(), met.part, met.keys, met.counts, KEEP + bits, by, KEEP + bits - by, met.extra))

    def passed_on(table: pa.Table, answers: pa.Table) -> pa.Table:
        met = _Met(table, KEEP + bits)
        totals = [_gathered(answers, kind, keys, KEEP + bits, by, met.part) for kind, keys in zip(("a_counts", "b_counts"), met.keys)]
        return met.answer(totals, _widest(answers.column("extra").to_pylist()))

    finer = exchange(blocked.groupBy("part", "block").applyInArrow(merge, ASKED), bits - by, max(1, blocks // BLOCK))
    back = finer.withColumns({"own": F.shiftright("part", by), "block": F.col("asker")})
    return blocked.groupBy("part", "block").cogroup(back.groupBy("own", "block")).applyInArrow(passed_on, ANSWERED)


def _gathered(answers: pa.Table, kind: str, keys: np.ndarray, bits: int, by: int, part: int = 0) -> np.ndarray:
    """Totals of ascending ``keys`` of ``bits`` bits out of one asker's answers from 2**by buckets."""
    cuts, _ = _cut(keys, bits, by)
    held = dict(zip(answers.column("part").to_pylist(), answers.column(kind).to_pylist()))
    pieces = [unpack(held.get(part << by | p, b""), cuts[p + 1] - cuts[p]) for p in range(1 << by) if cuts[p + 1] > cuts[p]]
    return np.concatenate(pieces) if pieces else np.zeros(0, np.int64)


# ---- automaton


def weights(state: np.ndarray, arc: np.ndarray, lower: np.ndarray, pseudo: np.ndarray | float) -> np.ndarray:
    """Probability of a word in a state: its arc's weight, or with no arc (0) that of the failure arc times the word's there."""
    return (arc + pseudo * lower) / (state + pseudo)


def level(state: np.ndarray) -> np.ndarray:
    """Range of a state by how often it was seen."""
    return np.searchsorted(RANGES, state, "right")


def chosen(sums: np.ndarray) -> np.ndarray:
    """The pseudo count of each range under which the training tokens, each left out, are most probable; the largest of equals."""
    table = sums.reshape(len(RANGES) + 1, len(PSEUDO))
    return np.array(PSEUDO)[len(PSEUDO) - 1 - np.argmax(table[:, ::-1], axis=1)]


def left_out(state: np.ndarray, arc: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Sum of log10 probabilities for each range and pseudo count, each token left out of its own counts."""
    out, own = np.zeros((len(RANGES) + 1, len(PSEUDO))), level(state)
    for k, pseudo in enumerate(PSEUDO):
        out[:, k] = np.bincount(own, np.log10(weights(state - 1.0, arc - 1.0, lower, pseudo)), len(out))
    return out.ravel()


class Automaton:
    """The states and arcs that a chunk's texts reach, with counts over the whole training corpus."""

    def __init__(self, chunk: Chunk, words: np.ndarray, pairs: np.ndarray, n: float, v: float):
        self.chunk, self.words, self.pairs, self.n, self.v = chunk, words, pairs, n, v
        #: How often the context of one word was seen, for each token; a text's start as often as its end.
        self.one = words[np.where(chunk.context < 0, chunk.end, chunk.context)]

    def root(self, less: int = 0) -> np.ndarray:
        """Probability of each token at the root; with ``less``, it is left out."""
        return (self.words[self.chunk.seq] - less + 1.0) / (self.n - less + self.v + 1.0)

    def second(self, pseudo: np.ndarray, less: int = 0) -> np.ndarray:
        """Probability of each token in the state of the word before it, or at the root where that isn't one."""
        one, lower = self.one - less, self.root(less)
        return np.where(one > 0, weights(one, self.pairs[self.chunk.pair] - less, lower, pseudo[level(self.one)]), lower)

    def pair_fit(self) -> np.ndarray:
        own = np.flatnonzero(self.chunk.train & (self.one > 1))
        return left_out(self.one[own], self.pairs[self.chunk.pair[own]], self.root(1)[own])

    def walk(self, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Read the texts: for each token the words in the state it is read from (0 to 2), that state's count, and how many failure arcs are taken.

        A token leads to the pair's state if that is one, else to its word's if
        the word is known, else to the root; the token after it is read from there.
        """
        chunk = self.chunk
        pair, word = self.pairs[chunk.pair], self.words[chunk.seq]
        leads = np.where(pair >= STATE, 2, np.where(word > 0, 1, 0))
        held = np.concatenate(([1], leads[:-1]))
        held[chunk.first] = 1 if self.words[chunk.end] > 0 else 0
        seen = np.where(held == 2, self.pairs[chunk.before], np.where(held == 1, self.one, 0))
        now, failed = held.copy(), np.zeros(len(held), np.int64)
        third = np.where(chunk.triple >= 0, triples[chunk.triple] if len(triples) else 0, 0)
        for words, arcs in ((2, third), (1, pair)):
            stuck = (now == words) & (arcs == 0)
            now[stuck], failed[stuck] = words - 1, failed[stuck] + 1
        return held, seen, failed


def _answered(chunk: Chunk, answers: pa.Table, by: int) -> tuple[Automaton, pa.Table, np.ndarray]:
    """The automaton up to pairs, the answers about triples, and what else was sent with these."""
    first, then = (answers.filter(pa.array(np.array(answers.column("round").to_numpy() == r))) for r in (1, 2))
    words, pairs = (_gathered(first, c, k, 64, by) for c, k in (("a_counts", chunk.words), ("b_counts", chunk.pairs)))
    told = _widest(first.column("extra").to_pylist())
    return Automaton(chunk, words, pairs, told[0], told[1]), then, _widest(then.column("extra").to_pylist())


def _ask_pairs(by: int, keep: int) -> Callable:
    def ask(packed: pa.Table) -> pa.Table:
        chunk = Chunk(packed)
        counts = [chunk.counts(chunk.seq, len(chunk.words)), chunk.counts(chunk.pair, len(chunk.pairs))]
        return _rows(ASKED, _asks(chunk.number, 0, [chunk.words, chunk.pairs], counts, 64, by, keep, np.zeros(0)))

    return ask


def _ask_triples(by: int, keep: int) -> Callable:
    def ask(packed: pa.Table, answers: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return _rows(ASKED, [])
        chunk = Chunk(packed)
        machine, _, _ = _answered(chunk, answers, by)
        chunk.triples(machine.pairs)
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return _rows(ASKED, _asks(chunk.number, 0, [none[0], chunk.thirds], [none[1], chunk.counts(chunk.triple, len(chunk.thirds))], 64, by, keep, machine.pair_fit()))

    return ask


_SCORED = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, lower double, cells array<double>, left_out array<double>"


def _score(by: int, doc_id: pa.DataType) -> Callable:
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([("doc_id", doc_id), *((n, kinds[t]) for n, t in (f.split() for f in _SCORED.split(", ")))])

    def score(packed: pa.Table, answers: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return schema.empty_table()
        chunk = Chunk(packed)
        machine, then, told = _answered(chunk, answers, by)
        chunk.triples(machine.pairs)
        triples = _gathered(then, "b_counts", chunk.thirds, 64, by)
        pseudo = chosen(told[2:])
        held, seen, _ = machine.walk(triples)
        docs, ranges, size = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes), len(RANGES) + 1, len(chunk.sizes)
        lower, at = machine.second(pseudo), np.flatnonzero(held == 2)
        arc = triples[chunk.triple[at]]
        cells, cell = np.zeros((size * ranges, len(PSEUDO))), docs[at] * ranges + level(seen[at])
        for k, one in enumerate(PSEUDO):
            cells[:, k] = np.bincount(cell, np.log10(weights(seen[at], arc, lower[at], one)), len(cells))
        own = at[chunk.train[at]]
        fit = left_out(seen[own], triples[chunk.triple[own]], machine.second(pseudo, 1)[own])
        per_doc = lambda values: np.bincount(docs, values, size)
        rest = np.where(held == 2, 0.0, np.log10(lower))
        return pa.table(
            [
                chunk.table.column("doc_id"),
                chunk.table.column("held_out"),
                pa.array(chunk.sizes),
                pa.array(per_doc(machine.words[chunk.seq] > 0).astype(np.int64)),
                pa.array(np.full(size, int(machine.n), np.int64)),
                pa.array(per_doc(np.log10(machine.root()))),
                pa.array(per_doc(rest)),
                pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), ranges * len(PSEUDO)).cast(pa.list_(pa.float64())),
                pa.array([fit.tolist()] + [None] * (size - 1), pa.list_(pa.float64())),
            ],
            schema=schema,
        )

    return score


def score(docs: DataFrame, held_out: Column, chunk_bytes: int = 8 << 20, bucket_bytes: int = BUCKET_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text), learning from rows where ``held_out`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    (log10).  A null text is empty: one end token.  A very long text is a chunk
    of its own.  A null ``held_out`` counts as false.  Repeated rows are scored
    and counted each, in whatever chunk they lie.  Without training rows every
    token has probability one.  An empty table gives an empty result; other
    columns, whatever their names, are ignored.

    A partition of ``docs`` computed again must give its rows in the same order,
    as scans of files do.
    """
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / bucket_bytes))))
    by = min(bits, fan_bits)
    blocks = max(1, math.ceil(size / chunk_bytes / BLOCK))
    keep = KEEP + bits - by
    chunks = rows.mapInArrow(_chunked(chunk_bytes), "chunk long, rows binary")
    grouped = chunks.groupBy("chunk")
    about_pairs = exchange(grouped.applyInArrow(_ask_pairs(by, keep), ASKED), bits - by, blocks).withColumn("round", F.lit(1))
    third = grouped.cogroup(about_pairs.groupBy("asker")).applyInArrow(_ask_triples(by, keep), ASKED)
    about_triples = exchange(third, bits - by, blocks).withColumn("round", F.lit(2))
    kind = docs.schema["doc_id"].dataType
    met = grouped.cogroup(about_pairs.unionByName(about_triples).groupBy("asker"))
    scored = materialise(met.applyInArrow(_score(by, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, {_SCORED}"), "scores")
    fit = {r["at"]: r["s"] for r in scored.where("left_out is not null").select(F.posexplode("left_out").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("s")).collect()}
    best = chosen(np.array([fit.get(i, 0.0) for i in range((len(RANGES) + 1) * len(PSEUDO))])).tolist()
    total = sum((F.col("cells")[r * len(PSEUDO) + PSEUDO.index(p)] for r, p in enumerate(best)), F.col("lower"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", total.alias("score"))
