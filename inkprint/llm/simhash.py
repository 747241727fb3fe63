"""SimHash near-duplicate groups with bit-sliced comparison.

Fingerprints are reduced to distinct values, dealt into blocks, and compared
inside a block on vertical bit planes: one machine word holds one bit of 64
fingerprints, carry-save adders turn the differing planes into bit-sliced
counts, and words in which every lane is beyond the radius are abandoned.

Blocks come from the pigeonhole principle (exact for a small radius): of m bit
fields at most ``radius`` can differ, so any two linked fingerprints agree on
some m - radius fields.  Blocks that are still large are cut again on the
fields left over, by the same principle.  Near duplicates by similarity are
nodes of one shingle set each, in blocks by min-hash bands of the shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import materialise, sliced, texts, tokens
from inkprint.llm.components import connected

SEED = 42
#: Lanes whose 64 planes are held at once.
CHUNK = 1 << 15
#: Up to this size a block is compared by shifts, beyond it query by query.
SMALL = 256
#: Blocks over this size are cut again.
LARGE = 4096
GROUP = 16
#: Ranges of the similarity sketch; a power of two.
BINS = 256


# ---- fingerprints


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each ``width``-word shingle, repeats included; of the whole sequence if it is shorter."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, n - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of ``hashes``; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def bands(hashes: np.ndarray, count: int, rows: int) -> list[int]:
    """``count`` keys, each from the smallest of ``rows`` rehashes: two sets with similarity s agree on a key with probability s**rows."""
    if not len(hashes):
        return [0] * count
    rng = np.random.default_rng(SEED)
    keys = []
    for band in range(count):
        key = np.uint64(band + 1)
        for _ in range(rows):
            mul, add = rng.integers(1, 2**63, 2, dtype=np.uint64) | np.uint64(1)
            low = ((hashes * mul) ^ ((hashes * mul) >> np.uint64(29))) * add
            key = (key ^ low.min()) * np.uint64(0x9E3779B97F4A7C15)
        keys.append(int(key.view(np.int64)))
    return keys


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One byte of the smallest hash in each of ``BINS`` ranges, 0 for an empty range: of two sets, the share of equal bytes estimates the similarity."""
    out = np.zeros(BINS, np.uint8)
    ordered = np.sort(hashes)
    bins, first = np.unique(ordered >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    out[bins.astype(np.int64)] = (ordered[first] & np.uint64(0xFF)).astype(np.uint8) | np.uint8(1)
    return out


def similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row; 1 for two empty ones."""
    used = ((left > 0) | (right > 0)).sum(axis=-1)
    same = ((left == right) & (left > 0)).sum(axis=-1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp long) of each document; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(text, width)) for text in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def signatures(docs: DataFrame, width: int, band_count: int, band_rows: int) -> DataFrame:
    """(doc_id, node long, fp long, keys array<long>, sketch binary) of each document; a null text is empty.

    All are made from distinct shingles.  ``node`` is a hash of their set: rows
    with the same one have similarity 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            nodes, prints, keys, sketches = [], [], [], []
            with np.errstate(over="ignore"):
                for text in texts(batch.column(1)):
                    hashes = np.unique(shingle_hashes(text, width))
                    nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                    prints.append(fingerprint(hashes))
                    keys.append(bands(hashes, band_count, band_rows))
                    sketches.append(sketch(hashes).tobytes())
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "node", "fp", "keys", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, fp long, keys array<long>, sketch binary")


# ---- bit-sliced comparison


def planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes of ``values``, lanes packed into words: row i has bit i of every value."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def lanes(mask: np.ndarray, n: int) -> np.ndarray:
    """Indices of the set lanes among the first ``n``."""
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])


def carry_save(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum planes of equal weight: rows[w] has planes of weight 2**w; returns one plane for each weight."""
    counts, level = [], 0
    while level < len(rows):
        stack = [np.atleast_2d(x) for x in rows[level]]
        x = np.concatenate(stack) if stack else None
        while x is not None and len(x) > 1:
            k = len(x) // 3
            if level + 1 == len(rows):
                rows.append([])
            if k:
                a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
                half = a ^ b
                rows[level + 1].append((a & b) | (c & half))
                x = np.concatenate((half ^ c, x[3 * k :]))
            else:
                rows[level + 1].append(x[0] & x[1])
                x = (x[0] ^ x[1])[None]
        counts.append(x[0] if x is not None else None)
        level += 1
    return counts


def beyond(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count exceeds ``radius``."""
    shape = next(c for c in counts if c is not None)
    more, equal = np.zeros_like(shape), np.full_like(shape, ~np.uint64(0))
    for w in reversed(range(max(len(counts), radius.bit_length()))):
        plane = counts[w] if w < len(counts) and counts[w] is not None else np.zeros_like(shape)
        if radius >> w & 1:
            equal = equal & plane
        else:
            more |= equal & plane
            equal = equal & ~plane
    return more


def within(differ: np.ndarray, radius: int) -> np.ndarray:
    """Mask of lanes with at most ``radius`` set planes in ``differ`` (64 x words).

    Planes are added ``GROUP`` at a time; words whose lanes are all beyond the
    radius are dropped from what remains.
    """
    words = differ.shape[1]
    alive, counts = np.arange(words), []
    for at in range(0, 64, GROUP):
        counts = carry_save([[differ[at : at + GROUP, alive]] + ([counts[0]] if counts and counts[0] is not None else []), *([c] if c is not None else [] for c in counts[1:])])
        over = beyond(counts, radius)
        keep = over != ~np.uint64(0)
        if not keep.all():
            alive, over, counts = alive[keep], over[keep], [c[keep] if c is not None else None for c in counts]
        if not len(alive):
            return np.zeros(words, np.uint64)
    mask = np.zeros(words, np.uint64)
    mask[alive] = ~over
    return mask


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _links_small(fps: np.ndarray, ends: np.ndarray, radius: int, agree: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted blocks; ends[i] is the end of the block that holds i."""
    a, b, shift = [], [], 1
    at = np.arange(len(fps))
    at = at[at + 1 < ends]
    while len(at):
        for start in range(0, len(at), CHUNK):
            part = at[start : start + CHUNK]
            hit = part[lanes(within(planes(fps[part] ^ fps[part + shift]), radius), len(part))]
            if agree:
                hit = hit[agree(hit, hit + shift)]
            a.append(hit)
            b.append(hit + shift)
        shift += 1
        at = at[at + shift < ends[at]]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _links_large(fps: np.ndarray, radius: int, agree: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one large block, grown from node to node over what isn't reached yet."""
    a, b, queue = [], [], []
    rest, sliced, waiting, first = np.arange(len(fps)), planes(fps), np.ones(len(fps), bool), 0
    left = len(fps)
    bits = np.arange(64, dtype=np.uint64)
    while left:
        if not queue:
            while not waiting[first]:
                first += 1
            queue.append(int(rest[first]))
            waiting[first] = False
            left -= 1
        node = queue.pop()
        ask = np.uint64(0) - ((fps[node] >> bits) & np.uint64(1))
        hit = lanes(within(sliced ^ ask[:, None], radius), len(rest))
        hit = hit[waiting[hit]]
        if agree and len(hit):
            hit = hit[agree(np.full(len(hit), node), rest[hit])]
        if len(hit):
            a.append(np.full(len(hit), node))
            b.append(rest[hit])
            queue += rest[hit].tolist()
            waiting[hit] = False
            left -= len(hit)
        if len(rest) > SMALL and 2 * left < len(rest):
            rest = rest[waiting]
            sliced, waiting, first = planes(fps[rest]), np.ones(len(rest), bool), 0
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(keys: np.ndarray, fps: np.ndarray, radius: int, sketches: np.ndarray | None = None, least: float = 0.0, nodes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reached) between different nodes of the same key; arrays sorted by (key, node).

    A fingerprint is its own node unless ``nodes`` are given.  With ``sketches``,
    a pair within the radius must also be ``least`` similar.
    """
    nodes = fps if nodes is None else nodes
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    ends = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    pick = np.flatnonzero(small)
    remap = np.cumsum(small) - 1
    test = (lambda base: lambda i, j: similarity(sketches[base[i]], sketches[base[j]]) >= least) if sketches is not None else lambda base: None
    a, b = _links_small(fps[pick], remap[ends[pick] - 1] + 1, radius, test(pick))
    found_a, found_b = [pick[a]], [pick[b]]
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        a, b = _links_large(fps[start : start + size], radius, test(np.arange(start, start + size)))
        found_a.append(a + start)
        found_b.append(b + start)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    label = _forest(len(fps), a, b)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    moved = moved[nodes[moved] != nodes[label[moved]]]
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int, least: float = 0.0, run_rows: int = 1 << 17) -> Callable:
    """Compare a partition (key, fp) or (key, node, fp, sketch) sorted by its first two columns, a run of whole blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray | None = None, sketches: np.ndarray | None = None) -> pa.RecordBatch:
            table = None if sketches is None else np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, BINS)
            nodes, fps = nodes.view(np.uint64), (nodes if fps is None else fps).view(np.uint64)
            a, b = links(keys, fps, radius, table, least, nodes)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(tuple(x.to_numpy(zero_copy_only=False) for x in batch.columns))
            if sum(len(x[0]) for x in held) >= run_rows:
                joint = [np.concatenate(x) for x in zip(*held)]
                whole = int(np.searchsorted(joint[0], joint[0][-1]))
                held = [tuple(x[whole:] for x in joint)]
                if whole:
                    yield out(*(x[:whole] for x in joint))
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    return run


# ---- exact similarity


def alike(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of non-empty ``sets`` (each of distinct values) that are ``least`` similar, grown like that of a large block."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    present = np.zeros(flat.max() + 1, bool)
    a, b = [], []
    rest, held, starts, waiting, left = np.arange(len(sets)), flat, bounds[:-1], np.ones(len(sets), bool), len(sets)
    for first in range(len(sets)):
        queue = [first] if waiting[first] else []
        left -= len(queue)
        waiting[first] = False
        while queue and left:
            node = queue.pop()
            if 2 * left < len(rest):
                rest = rest[waiting[rest]]
                held = np.concatenate([flat[bounds[i] : bounds[i + 1]] for i in rest])
                starts = np.concatenate(([0], np.cumsum(sizes[rest])[:-1]))
            own = flat[bounds[node] : bounds[node + 1]]
            present[own] = True
            both = np.add.reduceat(present[held], starts, dtype=np.int64)
            present[own] = False
            hit = rest[waiting[rest] & (both / (sizes[rest] + sizes[node] - both) >= least)]
            a.append(np.full(len(hit), node))
            b.append(hit)
            queue += hit.tolist()
            waiting[hit] = False
            left -= len(hit)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _decide(width: int, least: float) -> Callable:
    """Links among the texts of each component in a partition (top, node, text) sorted by (top, node), one component at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def out() -> pa.RecordBatch:
            a, b = alike(sets, least) if len(sets) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            named = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(named[a]), pa.array(named[b])], ["a", "b"])

        for batch in batches:
            for top, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                if top != now:
                    if nodes:
                        yield out()
                    now, nodes, sets = top, [], []
                if not nodes or nodes[-1] != node:  # rows equal in id and text come more than once
                    nodes.append(node)
                    sets.append(np.unique(shingle_hashes(text, width)))
        if nodes:
            yield out()

    return run


# ---- blocks


def fields(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """Bits [low, high) cut into ``parts`` fields (start, width)."""
    cuts = [low + (high - low) * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _field(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND((1 << width) - 1)


def pigeonhole(fp: Column, radius: int, parts: int) -> Column:
    """One key for each choice of ``parts - radius`` fields, which two values within the radius share at least once."""
    cut = fields(0, 64, parts)
    return F.array(*(F.xxhash64(F.lit(i), *(_field(fp, *cut[f]) for f in chosen)) for i, chosen in enumerate(combinations(range(parts), parts - radius))))


def _finer(fp: Column, key: Column, radius: int) -> Column:
    """Keys within a large block: the same principle with one field more, over a turned word, so its cuts fall elsewhere."""
    turned = F.shiftleft(fp, 8).bitwiseOR(F.shiftrightunsigned(fp, 56))
    return F.transform(pigeonhole(turned, radius, radius + 2), lambda k: F.xxhash64(key, k))


def _shared(blocked: DataFrame) -> DataFrame:
    """``blocked`` with the size ``n`` of the block, without blocks of one row."""
    sizes = blocked.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return blocked.join(sizes, "key")


def _named(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest ``rep`` reachable from each node of ``distinct`` (node, rep) over ``edges`` (a, b).

    Tables are written first: both sides of the last two joins then come straight
    from an exchange, where the rows of a hot node or component can be split.
    """
    members = materialise(distinct.join(connected(edges), "node", "left").select("node", "rep", F.coalesce("root", "node").alias("top")), "members")
    lowest = materialise(members.groupBy("top").agg(F.min("rep").alias("root")), "lowest")
    return materialise(members.join(lowest, "top").select("node", "root"), "named")


def group(prints: DataFrame, radius: int, large: int = LARGE) -> DataFrame:
    """(doc_id, fp, root) for fingerprint rows: root is the smallest doc_id reachable over links.

    Blocks come from the pigeonhole principle with as many fields as the number
    of distinct fingerprints asks for.
    """
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    n = distinct.count()
    parts = radius + (1 if n < 1 << 20 else 2 if n < 1 << 27 else 3)
    shared = _shared(distinct.select("fp", F.explode(pigeonhole(F.col("fp"), radius, parts)).alias("key")))
    finer = F.when(F.col("n") > large, _finer(F.col("fp"), F.col("key"), radius)).otherwise(F.array("key"))
    dealt = shared.select(F.explode(finer).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    edges = materialise(dealt.mapInArrow(_compare(radius), "a long, b long").distinct(), "links")
    named = _named(distinct.withColumnRenamed("fp", "node"), edges).withColumnRenamed("node", "fp")
    return prints.select("doc_id", "fp").join(named, "fp")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """Near-duplicate components of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    A null or blank text has fingerprint zero and links like any other.  Rows
    with equal texts share a fingerprint and so a component.  A null doc_id gets
    its component but never names one.  An empty table gives an empty result;
    other columns are ignored.
    """
    grouped = group(materialise(fingerprints(docs, width), "prints"), radius)
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("root").alias("component_id"))


@dataclass(frozen=True)
class Similar:
    """Near duplicates as texts whose ``width``-word shingle sets have a similarity of ``least`` or more.

    Two sets of similarity s share one of ``band_count`` keys with probability
    1 - (1 - s**band_rows)**band_count, all but 5e-6 at 0.8.  Fingerprints of
    such a pair are about 10 bits apart with a deviation of 3, sketches estimate
    its similarity with one of 0.025; ``radius`` and ``least - slack`` lie over
    five deviations off, so these two only spare work.  What they leave is
    decided on the shingle sets themselves.
    """

    width: int = 5
    least: float = 0.8
    slack: float = 0.15
    radius: int = 26
    band_count: int = 12
    band_rows: int = 2


def similar_groups(rows: DataFrame, similar: Similar) -> DataFrame:
    """(doc_id, node, root) for ``rows`` (doc_id, text): root is the smallest doc_id reachable over similar texts.

    Blocks find components of pairs that may be similar; in each of them all
    pairs count by their exact similarity.
    """
    prints = materialise(signatures(rows, similar.width, similar.band_count, similar.band_rows), "prints")
    distinct = materialise(prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min("sketch").alias("sketch")), "nodes")
    shared = _shared(distinct.select("node", F.explode("keys").alias("key")).distinct())
    dealt = shared.select("key", "node").join(distinct.select("node", "fp", "sketch"), "node").select("key", "node", "fp", "sketch")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "node")
    loose = materialise(dealt.mapInArrow(_compare(similar.radius, similar.least - similar.slack), "a long, b long").distinct(), "loose")
    pieces = materialise(connected(loose).select("node", F.col("root").alias("top")), "pieces")
    pieces = pieces.unionByName(pieces.select(F.col("top").alias("node"), "top").distinct())
    met = pieces.join(distinct.select("node", F.col("rep").alias("doc_id")), "node")
    sets = rows.join(met, "doc_id").select("top", "node", "text").repartition("top").sortWithinPartitions("top", "node")
    edges = materialise(sets.mapInArrow(_decide(similar.width, similar.least), "a long, b long"), "links")
    return prints.select("doc_id", "node").join(_named(distinct.select("node", "rep"), edges), "node")


def keep_one(docs: DataFrame, similar: Similar = Similar()) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id, and all columns.

    A row without doc_id counts as larger than any other, ordered by its text's
    hash; of rows equal in doc_id and text one stays.  Null and blank texts form
    one group; a text under ``similar.width`` words is one shingle; very long
    ones count whole.  Every column keeps its value, whatever its name.  An
    empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.xxhash64(text)
    key = {"n": F.col("doc_id").isNull(), "k": F.coalesce(F.col("doc_id").cast("long"), digest), "h": digest}
    rows = docs.select(F.struct(*(c.alias(n) for n, c in key.items())).alias("doc_id"), "text")
    roots = similar_groups(rows, similar).where("doc_id = root").select("root.*").distinct()
    # the columns travel in one struct, so that no name of theirs meets one made here
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in key.items()))
    return packed.join(roots, list(key), "left_semi").dropDuplicates(list(key)).select("row.*")
