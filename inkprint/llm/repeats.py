"""Exact removal of long repeated byte strings with suffix arrays and their interval trees.

A string of ``length`` bytes is a repeat if it starts at two or more places of
the corpus.  Candidates come first, without moving text:

1.  Winnowing: of the ``gram``-byte hashes inside a window of ``length`` bytes
    the smallest (leftmost on ties) is the window's anchor.  It depends on the
    window's bytes alone, so equal windows have equal anchors at equal offsets.
    Consecutive windows with one anchor make a segment; a document is cut into
    about one segment every ``(length - gram) / 2`` bytes.
2.  A segment whose anchor hash occurs once is new text.  Of all others one
    representative for each different segment is fetched, with the number of
    places where it occurs; only of these is text moved.
3.  Segments of an anchor meet in one batch.  A suffix array with common-prefix
    lengths is built over them; a stack scan of the lengths walks the interval
    tree; intervals at least ``length`` deep whose occurrences differ in the
    byte to the left are the maximal repeats, each with all its occurrences.  A
    segment that stands for several places is a leaf of the tree that is a
    repeat by itself.  What is removed comes from these: at the place of a
    segment, or at all places of one that has several.

An anchor whose different segments have more than ``group_bytes`` isn't
gathered: the windows of its segments go out one by one as hashes and are
counted, each a leaf interval of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inkprint.llm.common import discard, materialise, sliced, texts, utf8

#: Odd base and byte weights of the rolling hashes; any odd numbers do.
_RNG = np.random.default_rng(7)
_BASE = [int(x) | 1 for x in _RNG.integers(1, 2**63, 2)]
_WEIGHT = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once; also how far positions reach in an anchor's low bits.
SPAN = 1 << 20
#: Parts that the places of one segment are counted in.
SALTS = 256
#: Segments of one anchor are compared in one task up to so many bytes: its suffix array takes about 100 times as much.
GROUP_BYTES = 1 << 20
_LOW = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hash of any substring of ``data`` from one running sum of weighted powers."""

    cached: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        n = len(data)
        if which not in self.cached or len(self.cached[which][0]) <= n:
            size = max(n + 1, SPAN + 1024)
            self.cached[which] = _powers(_BASE[which], size), _powers(pow(_BASE[which], -1, 1 << 64), size)
        up, self.down = self.cached[which]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_WEIGHT[which][data] * up[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def segments(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Segments of the texts laid end to end in ``data``: row, key, seg, at, lo, n (windows lo..lo+n-1, relative to the row)."""
    empty = {k: np.zeros(0, np.int64) for k in ("row", "key", "seg", "at", "lo", "n")}
    if len(data) < length:
        return empty
    with np.errstate(over="ignore"):
        first = Rolling(data, 0)
        grams = first.every(gram)
        ranked = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_least(ranked, length - gram + 1) & _LOW).astype(np.int64)
        sizes = np.maximum(np.diff(bounds) - length + 1, 0)
        row = np.repeat(np.arange(len(sizes)), sizes)
        if not len(row):
            return empty
        start = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[:-1], sizes)
        anchor = anchor[start]
        cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
        last = np.concatenate((cut[1:], [len(row)])) - 1
        lo, hi, at, row = start[cut], start[last], anchor[cut], row[cut]
        seg = Rolling(data, 1).hash(lo, hi + length)
        seg = _mixed(seg + ((at - lo).astype(np.uint64) << np.uint64(20)) + (hi - lo).astype(np.uint64))
    base = bounds[row]
    return {"row": row, "key": grams[at].view(np.int64), "seg": seg.view(np.int64), "at": at - base, "lo": lo - base, "n": hi - lo + 1}


def _runs(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SPAN bytes."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SPAN, "right")) - 1)
        yield first, last
        first = last


def _pieces(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    for first, last in _runs(data, bounds):
        a, b = int(bounds[first]), int(bounds[last])
        if b - a <= 8 * SPAN:
            found = segments(data[a:b], bounds[first : last + 1] - a, length, gram)
            yield found | {"row": found["row"] + first}
            continue
        step = 4 * SPAN  # one very long text: windows are cut into ranges
        for at in range(a, b, step):
            end = min(b, at + step + length - 1)
            found = segments(data[at:end], np.array([0, end - at]), length, gram)
            yield found | {"row": found["row"] + first, "at": found["at"] + (at - a), "lo": found["lo"] + (at - a)}


def _find(length: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(0))
            r1, r2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for x in _pieces(data, bounds, length, gram):
                columns = [r1[x["row"]], r2[x["row"]], x["key"], x["seg"], x["at"].astype(np.int32), x["lo"].astype(np.int32), x["n"].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["r1", "r2", "key", "seg", "at", "lo", "n"])

    return run


# ---- enhanced suffix array


#: Bytes that the first ranks tell apart at once.
WORD = 8


class Suffixes:
    """Suffixes of strings laid end to end, in order, with common-prefix lengths.

    Ranks start from words of eight bytes and are refined by doubling; only
    suffixes that share their rank with another are sorted again.  The end of a
    string is unlike any byte and any other end.  ``ranks[k]`` tells apart the
    first ``WORD * 2**k`` bytes: equal ranks are equal bytes.
    """

    def __init__(self, strings: list[bytes], depth: int):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        data = np.frombuffer(b"".join(strings), np.uint8)
        self.data, n = data, len(data)
        self.owner = np.repeat(np.arange(len(strings), dtype=np.int32), self.sizes)
        #: Bytes from each place to the end of its string.
        self.left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(n)
        wide = np.concatenate((data, np.zeros(WORD, np.uint8))).astype(np.uint64)
        words = np.zeros(n, np.uint64)
        for k in range(WORD):
            words = (words << np.uint64(8)) | np.where(k < self.left, wide[k : n + k], np.uint64(0))
        self.words = words
        short = self.left < WORD
        order = np.argsort(words)
        equal = words[order[1:]] == words[order[:-1]]
        if (equal & (short[order[1:]] != short[order[:-1]])).any():  # bytes of zero: an end looks like a word
            order = np.lexsort((np.where(short, np.arange(n) + 1, 0), words))
        fresh = np.ones(n, bool)
        fresh[1:] = (words[order[1:]] != words[order[:-1]]) | short[order[1:]] | short[order[:-1]]
        rank = np.empty(n, np.int32)
        rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        self.ranks, width = [rank], WORD
        tied = np.ones(n, bool)
        while width < depth:
            tied = self._shared(rank, order, tied)
            at = np.flatnonzero(tied)
            if not len(at):
                break
            # both halves lie within one string: a shorter suffix has a rank of its own by now
            second = rank[np.minimum(at + width, n - 1)].astype(np.int64)
            mine = np.argsort(rank[at] * np.int64(n + 1) + second, kind="stable")
            at, key = at[mine], (rank[at] * np.int64(n + 1) + second)[mine]
            places = np.sort(rank[at].astype(np.int64))  # the first place of its group, for each
            first = np.concatenate(([True], places[1:] != places[:-1]))
            places += np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            new = rank.copy()
            new[at] = places[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
            order = order.copy()
            order[places] = at
            rank = new
            self.ranks.append(rank)
            width *= 2
        self.order, self.width = order, width

    @staticmethod
    def _shared(rank: np.ndarray, order: np.ndarray, tied: np.ndarray) -> np.ndarray:
        """Which suffixes have the rank of another."""
        ordered = rank[order]
        same = np.zeros(len(rank), bool)
        equal = ordered[1:] == ordered[:-1]
        same[order[1:][equal]] = same[order[:-1][equal]] = True
        return same & tied

    def common(self, least: int) -> np.ndarray:
        """Common-prefix length of each suffix and the one before it in order; 0 where it is under ``least``."""
        n, out = len(self.order), np.zeros(len(self.order), np.int64)
        level = min(len(self.ranks) - 1, max(0, (least // WORD).bit_length() - 1))
        near = np.flatnonzero(self.ranks[level][self.order[1:]] == self.ranks[level][self.order[:-1]]) + 1
        a, b, length = self.order[near - 1], self.order[near], np.zeros(len(near), np.int64)
        room = np.minimum(self.left[a], self.left[b])
        for k in reversed(range(len(self.ranks))):
            inside = length + (WORD << k) <= room
            i, j = np.where(inside, a + length, a), np.where(inside, b + length, b)
            length += np.where(inside & (self.ranks[k][i] == self.ranks[k][j]), WORD << k, 0)
        rest = room - length
        i, j = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        differ = self.words[i] ^ self.words[j]
        same = WORD - np.ceil(np.log2(differ.astype(np.float64) + 1) / 8).astype(np.int64)
        # the logarithm is that of a rounded number: at the edge of a byte look again
        same = np.where((same < WORD) & (differ >> np.uint64(8) * (WORD - 1 - np.minimum(same, WORD - 1)).astype(np.uint64) == 0), same + 1, same)
        length += np.minimum(rest, same)
        out[near] = np.where(length >= least, length, 0)
        return out


def intervals(sa: np.ndarray, lcp: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal repeats (depth, first, last): common-prefix intervals sa[first..last] of depth ``least`` or more with diverse left bytes.

    One pass with a stack.  ``left[i]`` is the symbol before sa[i]; a text start
    is unlike any other symbol.  An interval carries the one left symbol seen in
    it, or -1 once two differ.
    """
    out: list[tuple[int, int, int]] = []
    starts = np.flatnonzero(lcp >= least)
    if not len(starts):
        return out
    breaks = np.flatnonzero(np.diff(starts) > 1)
    for a, b in zip(np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(starts) - 1]))):
        first, last = int(starts[a]) - 1, int(starts[b])
        depths, before = lcp[first : last + 1].tolist() + [0], left[first : last + 1].tolist()
        stack: list[list[int]] = []
        for i in range(1, last - first + 2):
            depth, begin, seen = depths[i], i - 1, before[i - 1]
            while stack and stack[-1][0] > depth:
                d, begin, s = stack.pop()
                seen = s if s == seen else -1
                if seen == -1:
                    out.append((d, first + begin, first + i - 1))
                if stack and stack[-1][0] >= depth:
                    stack[-1][2] = seen if stack[-1][2] == seen else -1
            if depth >= least:
                if not stack or stack[-1][0] < depth:
                    stack.append([depth, begin, seen])
                else:
                    stack[-1][2] = seen if stack[-1][2] == seen else -1
    return out


def maximal_repeats(strings: list[bytes], least: int, times: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of ``least`` bytes or more among ``strings``: (length, strings, offsets) with all occurrences.

    A string that stands for several places (``times``) is a repeat as a whole:
    its leaf in the interval tree is an interval of its own.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    if not sizes.sum():
        return
    made = Suffixes(strings, int(sizes.max()))
    before = np.where(made.order == made.starts[made.owner[made.order]], -2 - made.owner[made.order].astype(np.int64), made.data[np.maximum(made.order, 1) - 1])
    owner = made.owner[made.order]
    offset = made.order - made.starts[owner]
    for depth, first, last in intervals(made.order, made.common(least), before, least):
        yield depth, owner[first : last + 1], offset[first : last + 1]
    for i in np.flatnonzero((times > 1) & (sizes >= least)).tolist() if times is not None else ():
        yield int(sizes[i]), np.array([i]), np.array([0])


def covered(strings: list[bytes], times: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Byte ranges of each segment that the maximal repeats of ``length`` bytes or more among all of them cover.

    ``times[i]`` is the number of places where segment i occurs.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in strings]
    for depth, owner, offset in maximal_repeats(strings, length, times):
        for o, at in zip(owner.tolist(), offset.tolist()):
            found[o].append((at, at + depth))
    return [_merged(x) for x in found]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


#: A segment's representative: its anchor, its hash, one place of it, the number of places.
_HEAD = {"key": "long", "seg": "long", "r1": "long", "r2": "long", "lo": "int", "n": "int", "total": "long"}
_FOUND = "key long, seg long, total long, r1 long, r2 long, lo int, hi int"


def _found(table: pa.Table, which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Ranges lo-hi of the segments in the rows ``which`` of ``table``."""
    taken = [pa.array(table.column(c).to_numpy()[which]) for c in ("key", "seg", "total", "r1", "r2")]
    return pa.RecordBatch.from_arrays([*taken, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["key", "seg", "total", "r1", "r2", "lo", "hi"])


def _compare(length: int, batch_bytes: int = 1 << 18) -> Callable:
    """Scan a partition sorted by key, whole keys at a time, for what is covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            ranges = covered(list(texts(table.column("body"))), table.column("total").to_numpy(), length)
            which = np.repeat(np.arange(table.num_rows), [len(x) for x in ranges])
            flat = np.array([y for x in ranges for y in x], np.int64).reshape(-1, 2)
            base = table.column("lo").to_numpy()[which]
            return _found(table, which, base + flat[:, 0], base + flat[:, 1])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                held.append(batch.slice(at, 1024))
                if sum(x.num_rows for x in held) * 1.4 * length < batch_bytes:
                    continue
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                whole = int(np.flatnonzero(keys == keys[-1])[0])
                if whole:
                    yield out(table.slice(0, whole))
                    held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield out(pa.Table.from_batches(held))

    return run


def _fetch(length: int) -> Callable:
    """Cut the wanted segments out of their texts."""
    names = [*_HEAD, "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            flat = wanted.flatten()
            own = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy())).tolist()
            lo, n = (flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("lo", "n"))
            bodies, view = [], list(texts(batch.column(0)))
            for i, (r, a, m) in enumerate(zip(own, lo, n)):
                bodies.append(view[r][a : a + m + length - 1])
                if len(bodies) == 4096 or i + 1 == len(own):
                    first = i + 1 - len(bodies)
                    yield pa.RecordBatch.from_arrays([flat.field(c).slice(first, len(bodies)) for c in names] + [pa.array(bodies, pa.binary())], [*names, "body"])
                    bodies = []

    return run


def _windows(length: int) -> Callable:
    """Hash every window of the segments of wide anchors: the columns of what is found, and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            data, bounds = utf8(table.column("body"))
            n = table.column("n").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = bounds[row] + at
            with np.errstate(over="ignore"):
                hashes = [pa.array(Rolling(data, w).hash(start, start + length).view(np.int64)) for w in (0, 1)]
            lo = table.column("lo").to_numpy()[row] + at
            made = _found(table, row, lo, lo + length)
            yield pa.RecordBatch.from_arrays([*made.columns, *hashes], [*made.schema.names, "w1", "w2"])

    return run


# ---- the operator


def _identified(docs: DataFrame) -> DataFrame:
    """r1 and r2 name a row; rows equal in doc_id and text share them, and share their result."""
    return docs.withColumn("r1", F.xxhash64("doc_id", "text")).withColumn("r2", F.xxhash64(F.lit(1), "text"))


def repeat_ranges(docs: DataFrame, length: int = 200, gram: int = 32, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(r1, r2, lo, hi): byte ranges of rows covered by strings of ``length`` bytes that also start elsewhere."""
    rows = _identified(docs.select("doc_id", "text"))
    parts = materialise(rows.select("text", "r1", "r2").mapInArrow(_find(length, gram), "r1 long, r2 long, key long, seg long, at int, lo int, n int"), "segments")
    # Written first, so that both sides of the join below come straight from an
    # exchange, where a hot anchor's rows can be split among tasks.
    keys = materialise(parts.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"), "keys")
    shared = materialise(parts.join(keys, "key").select("key", "seg", "r1", "r2", "lo", "n"), "shared")
    discard(parts)
    # The places of each segment are counted within salts first, so that a segment
    # of any number of rows is shared among tasks; then one row of each salt is
    # counted again.  Rows are only told their number, none are made.
    within, across = Window.partitionBy("key", "seg", "salt"), Window.partitionBy("key", "seg")
    salted = shared.withColumn("salt", F.pmod("r1", F.lit(SALTS)))
    rows_of = materialise(salted.withColumns({"same": F.count("*").over(within), "nth": F.row_number().over(within.orderBy("r1", "r2", "lo"))}), "places")
    discard(shared)
    firsts = rows_of.where("nth = 1").withColumns({"total": F.sum("same").over(across), "salts": F.count("*").over(across), "head": F.row_number().over(across.orderBy("salt"))})
    firsts = materialise(firsts, "firsts")
    heads = firsts.where("head = 1")
    # What the different segments of an anchor weigh decides how they are compared.
    weighed = heads.groupBy("key").agg(F.sum(F.col("n") + F.lit(length - 1)).alias("bytes")).where(F.col("bytes") > group_bytes).select("key", F.lit(True).alias("wide"))
    wanted = heads.join(weighed, "key", "left").select("r1", "r2", F.struct(*_HEAD, F.coalesce("wide", F.lit(False)).alias("wide")).alias("w"))
    wanted = wanted.groupBy("r1", "r2").agg(F.collect_list("w").alias("wanted"))
    fetched = rows.join(wanted, ["r1", "r2"]).select("text", "wanted")
    bodies = materialise(fetched.mapInArrow(_fetch(length), ", ".join(f"{c} {t}" for c, t in _HEAD.items()) + ", wide boolean, body binary"), "bodies")
    narrow = bodies.where("not wide").repartition("key").sortWithinPartitions("key")
    scanned = narrow.mapInArrow(_compare(length), _FOUND)
    windows = bodies.where("wide").mapInArrow(_windows(length), f"{_FOUND}, w1 long, w2 long")
    again = windows.groupBy("w1", "w2").agg(F.sum("total").alias("times")).where("times > 1").select("w1", "w2")
    found = materialise(scanned.unionByName(windows.join(again, ["w1", "w2"]).drop("w1", "w2")), "repeats")
    # A segment with several places is a leaf that is a repeat as a whole, at each of them.
    several = rows_of.where("same > 1").select("r1", "r2", "lo", "n").unionByName(firsts.where("same = 1 and salts > 1").select("r1", "r2", "lo", "n"))
    places = several.select("r1", "r2", "lo", (F.col("lo") + F.col("n") + F.lit(length - 1)).alias("hi"))
    return found.where("total = 1").select("r1", "r2", "lo", "hi").unionByName(places)


def _kept(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``data``, and the number of bytes and of runs removed."""
    out, at, removed, spans, until = [], 0, 0, 0, -1
    for lo, hi in sorted(ranges):
        if lo > until:
            spans += 1
            out.append(data[at:lo])
        until = max(until, hi)
        if until > max(at, lo):
            removed += until - max(at, lo)
            at = until
    out.append(data[at:])
    return b"".join(out), removed, spans


_RESULT = StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept_text", "string")


def _strip(keep_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, removed, spans, digests, kept = [], [], [], [], []
            lists = batch.column(1)
            flat, ends = lists.flatten(), np.cumsum(np.array([len(x) if x.is_valid else 0 for x in lists], np.int64))
            los, his = (flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("lo", "hi"))
            begin = 0
            for text, end in zip(texts(batch.column(0)), ends.tolist()):
                left, gone, runs = _kept(text, list(zip(los[begin:end], his[begin:end])))
                begin = end
                sizes.append(len(text))
                removed.append(gone)
                spans.append(runs)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode(errors="ignore") if keep_text else None)
            made = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)] + [pa.array(x, pa.string()) for x in (digests, kept)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.StructArray.from_arrays(made, _RESULT.names)], ["row", "made"])

    return run


def _stripped(docs: DataFrame, row: Column, length: int, gram: int, group_bytes: int, keep_text: bool) -> DataFrame:
    """(row, made): ``row`` as it was, and the result for its text.  No column of ``docs`` but doc_id and text is seen by name."""
    ranges = repeat_ranges(docs, length, gram, group_bytes).groupBy("r1", "r2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    rows = _identified(docs.select("doc_id", "text", row.alias("row"))).join(ranges, ["r1", "r2"], "left").select("text", "ranges", "row")
    return rows.mapInArrow(_strip(keep_text), StructType([rows.schema["row"], StructField("made", _RESULT)]))


def strip_repeats(docs: DataFrame, length: int = 200, gram: int = 32, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts elsewhere in ``docs`` (doc_id, text).

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256.  Strings are judged
    on the input; all places go, the first too.  A null text is empty; texts
    shorter than ``length`` have nothing to remove; very long ones are cut into
    ranges of windows; rows equal in doc_id and text are two places each.  An
    empty table gives an empty result; other columns, whatever their names, are
    ignored.
    """
    return _stripped(docs, F.struct("doc_id"), length, gram, group_bytes, False).select("row.doc_id", "made.n_bytes", "made.n_removed", "made.n_spans", "made.kept_sha256")


def cut_repeats(docs: DataFrame, length: int = 200, gram: int = 32, group_bytes: int = GROUP_BYTES, size: str | None = None) -> DataFrame:
    """``docs`` with all rows and columns and what ``strip_repeats`` leaves as text; the column ``size``, if named, gets its characters.

    A character cut in two is dropped.  A null text stays null.  Every other
    column keeps its value, whatever its name.
    """
    made = _stripped(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), length, gram, group_bytes, True)
    left = F.when(F.col("row.text").isNotNull(), F.col("made.kept_text"))
    new = {"text": left} | ({size: F.length(left).cast("long")} if size in docs.columns else {})
    return made.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
