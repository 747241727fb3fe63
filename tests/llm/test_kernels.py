"""Kernels of the corpus operators against definitions, without Spark."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from inkprint.llm import bpe, fertility, language, lm, mixture, quality, repeats, simhash, topk

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    made = bpe.encoder(RANKS, P.PATTERN)
    return made, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=made.ranks, special_tokens={})


def test_bpe_equals_library(both):
    made, other = both
    rng = random.Random(3)
    signs = list(" \n\t\r\x0b\x1c\x85 ab'stREvé中😀٣1²$_-ßaaa  ' '")
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        ids = made.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
        assert made.decode(ids) == text.encode()


def test_bpe_pieces(both):
    made, other = both
    rng, some = random.Random(4), [t for t in made.ranks if len(t) > 3]
    for _ in range(4000):
        piece = b"".join(rng.choice(some) for _ in range(rng.randrange(1, 6)))
        assert made.piece(piece) == other._core_bpe.encode_single_piece(piece)


def test_bpe_long(both):
    made, other = both
    text = "ab" * 20000 + "c" * 20000 + "  " * 9000
    assert np.frombuffer(made.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def _marks(strings, length):
    count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    out = []
    for s in strings:
        mark = [False] * len(s)
        for i in range(len(s) - length + 1):
            if count[s[i : i + length]] > 1:
                mark[i : i + length] = [True] * length
        out.append(mark)
    return out


def _strings(rng):
    base = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(30, 200))) for _ in range(3)]
    out = []
    for _ in range(rng.randrange(1, 7)):
        s = b""
        for _ in range(rng.randrange(1, 4)):
            b = rng.choice(base)
            i = rng.randrange(len(b))
            s += b[i : i + rng.randrange(80)] if rng.random() < 0.7 else bytes(rng.choice(b"ab") for _ in range(rng.randrange(20)))
        out.append(s)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_maximal_repeats(seed):
    rng = random.Random(seed)
    strings, length = _strings(rng), 25
    got = [[False] * len(s) for s in strings]
    for depth, owner, offset in repeats.maximal_repeats(strings, length):
        places = list(zip(owner.tolist(), offset.tolist()))
        assert len(set(places)) > 1 and len({strings[o][p : p + depth] for o, p in places}) == 1
        before = {strings[o][p - 1 : p] if p else (o, "start") for o, p in places}
        after = {strings[o][p + depth : p + depth + 1] or (o, "end") for o, p in places}
        assert len(before) > 1 and len(after) > 1  # can't be longer
        everywhere = {(o, p) for o, s in enumerate(strings) for p in range(len(s)) if s[p : p + depth] == strings[places[0][0]][places[0][1] : places[0][1] + depth]}
        assert set(places) == everywhere  # all occurrences
        for o, p in places:
            got[o][p : p + depth] = [True] * depth
    assert got == _marks(strings, length)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    rng = random.Random(seed)
    strings = [s for s in _strings(rng) if s] + [b"\0" * 13, b"\0" * 9, b"\xff\xfe" * 20, b"a" * 40]
    made = repeats.Suffixes(strings, max(map(len, strings)))
    places = [(o, int(i - made.starts[o])) for i, o in zip(made.order, made.owner[made.order])]
    assert sorted(places) == [(o, p) for o, s in enumerate(strings) for p in range(len(s))]
    common = made.common(repeats.WORD)
    for (a, p), (b, q), n in zip(places, places[1:], common[1:].tolist()):
        x, y = strings[a][p:], strings[b][q:]
        same = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert n == (same if same >= repeats.WORD else 0)
        assert same in (len(x), len(y)) or x[same] < y[same]


def test_segments_agree_on_equal_windows():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 400, dtype=np.uint8)
    made = [np.concatenate((rng.integers(97, 123, n, dtype=np.uint8), passage, rng.integers(97, 123, 90, dtype=np.uint8))) for n in (10, 333)]
    bounds = np.cumsum([0] + [len(m) for m in made])
    found = repeats.segments(np.concatenate(made), bounds, 200, 32)
    for row, text in enumerate(made):
        mine = found["row"] == row
        covered = np.concatenate([np.arange(a, a + n) for a, n in zip(found["lo"][mine], found["n"][mine])])
        assert (covered == np.arange(len(text) - 199)).all()  # every window belongs to one segment
    keys = [set(found["key"][(found["row"] == r)]) for r in (0, 1)]
    assert keys[0] & keys[1]


@pytest.mark.parametrize("small", [256, 4])
def test_links(small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(2)
    values = set()
    for base in rng.integers(0, 2**64, 25, dtype=np.uint64):
        for _ in range(int(rng.integers(1, 12))):
            x = int(base)
            for _ in range(int(rng.integers(0, 4))):
                x ^= 1 << int(rng.integers(64))
            values.add(x)
    fps = np.array(sorted(values), np.uint64)
    keys = np.sort(rng.integers(0, 3, len(fps)))
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in zip(*(x.tolist() for x in simhash.links(keys, fps, 3))):
        assert a != b
        root[find(a)] = find(b)
    want = {}
    for i in range(len(fps)):
        for j in range(i):
            if keys[i] == keys[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 3:
                assert find(int(fps[i])) == find(int(fps[j]))
                want.setdefault(i, []).append(j)
    for x in list(root):  # nothing is linked that isn't reachable
        group = {int(f) for f in fps if find(int(f)) == find(x)}
        seen, todo = {x}, [x]
        while todo:
            y = todo.pop()
            new = {z for z in group - seen if (y ^ z).bit_count() <= 3}
            seen |= new
            todo += new
        assert seen == group


def test_within_any_radius():
    values = np.random.default_rng(0).integers(0, 2**64, 500, dtype=np.uint64)
    for radius in (0, 3, 7, 16, 30):
        x = values ^ values[0]
        assert (simhash.lanes(simhash.within(simhash.planes(x), radius), 500) == np.flatnonzero(np.bitwise_count(x) <= radius)).all()


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    b = np.concatenate((a[:1800], rng.integers(0, 2**64, 200, dtype=np.uint64)))
    assert abs(float(simhash.similarity(simhash.sketch(a), simhash.sketch(b))) - 1800 / 2200) < 0.1


def test_topk_block_equals_product():
    rng = np.random.default_rng(6)
    block, asked = rng.integers(-1000, 1000, (400, 16)).astype(float), rng.integers(-1000, 1000, (30, 16)).astype(float)
    block[50:90] = block[50]
    ids, qids = np.arange(400), np.arange(0, 300, 10)
    got = {int(q[0]): (v.tolist(), s.tolist()) for q, v, s, _ in topk.aggregate_block(ids, block, qids, asked, 10)}
    for i, q in enumerate(qids):
        scores = block @ asked[i]
        order = sorted((-scores[j], j) for j in range(400) if j != q)[:10]
        assert got[q] == ([j for _, j in order], [-s for s, _ in order])


def test_topk_reads_in_order_and_stops():
    rng = np.random.default_rng(11)
    block = np.floor(rng.normal(size=(3000, 12)) * 1000 * 0.4 ** np.arange(12))
    query = block[7]
    reader = topk.Reader(topk.Lists.of(block), query)
    scores, last, worth = block @ query, reader.gap(), block * query
    read = np.zeros(block.shape, bool)
    while reader.at < reader.width:
        j = reader.order[reader.at]
        who = reader.step(700)
        assert not read[who, j].any()
        read[who, j] = True
        lower, upper = reader.bounds()
        assert (lower <= scores).all() and (scores <= upper).all() and reader.gap() <= last
        assert read[:, j].sum() == reader.depth[j] and (read[:, j].all() or worth[read[:, j], j].min() >= worth[~read[:, j], j].max())  # the best end
        last = reader.gap()
    assert (lower == scores).all() and (upper == scores).all()
    ((_, found, _, (decided, read)),) = topk.aggregate_block(np.arange(3000), block, np.array([7]), query[None], 10)
    assert decided < 0.6 and decided < read < 1 and found.tolist() == [i for i in np.argsort(-scores, kind="stable").tolist() if i != 7][:10]


def test_pack():
    counts = np.array([0, 1, 254, 255, 256, 10**6])
    assert (lm.unpack(lm.pack(counts), 6) == counts).all()


@pytest.mark.parametrize("bits", [8, 16, 40, 44, 50, 56])
@pytest.mark.parametrize("n", [0, 1, 300, 9000])
def test_coded_keys(bits, n):
    values = np.sort(np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64))
    assert (lm.decode(lm.encode(values, bits), bits) == values).all()


def test_weights_of_a_state_sum_to_one():
    lower, arcs = np.array([0.5, 0.3, 0.2]), np.array([4, 1, 0])
    assert lm.weights(np.full(3, 5), arcs, lower, 7.0).sum() == pytest.approx(1)


def test_repeated_words():
    rng = random.Random(8)
    for _ in range(200):
        ids = np.array([rng.randrange(3) for _ in range(rng.randrange(40))], np.int64)
        runs = Counter(tuple(ids[i : i + 5]) for i in range(len(ids) - 4))
        want = {k for i in range(len(ids) - 4) if runs[tuple(ids[i : i + 5])] > 1 for k in range(i, i + 5)}
        assert fertility.repeated_words(ids) == len(want)


def test_raking_meets_margins():
    keys = [(s, lang, "t") for s in "abc" for lang in "xy"]
    tokens = np.array([600.0, 100, 200, 90, 50, 40])
    targets = mixture.Targets(volume=0.3, shares={"lang": {"x": 0.6, "y": 0.4}})
    rate = mixture.rake(keys, tokens, targets)
    kept = rate * tokens
    assert (rate <= 1).all() and kept.sum() == pytest.approx(0.3 * tokens.sum(), rel=1e-3)
    assert kept[::2].sum() / kept.sum() == pytest.approx(0.6, rel=1e-3)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(9)
    rows, grades = [], []
    for i in range(900):
        g = i % 3
        rows.append(np.unique(np.concatenate((rng.integers(100, 160, 20), [g] if rng.random() < 0.95 else []))).astype(np.int64))
        grades.append(g)
    model = quality.fit(rows, np.array(grades), 3, quality.Settings(bits=8, least_documents=5))
    assert model.thresholds[0] < model.thresholds[1] and model.weights[0] < model.weights[1] < model.weights[2] + 1e-9
    score = np.array([model.weights[r].sum() for r in rows])
    best = 1 - model.below(score)[:, -1]
    assert (best[2::3] > 0.5).mean() > 0.9 and (best[0::3] > 0.5).mean() < 0.1


def test_language_vectors():
    a = language.counts([b"hello world", b"", b"12 34"])
    assert a[0].sum() == 11 and a[1].sum() == 0
    v = language.vectors(a, np.ones(language.DIMENSIONS, np.float32))
    assert np.linalg.norm(v[0]) == pytest.approx(1) and not v[1].any()


def test_topic_vectors_touch_only_what_a_text_has():
    """Hashed vectors as by whole rows of trigrams, pieces of a long text included, in a tenth of their memory."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéñ中") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    batch = [" ".join(rng.choices(words, k=350)).encode() for _ in range(256)]
    odd = [b"", b" ", b"a", b"12 34", " ".join(rng.choices(words, k=200_000)).encode()]
    idf = np.random.default_rng(12).uniform(1, 9, language.DIMENSIONS).astype(np.float32)

    def whole(group):
        rows = language.vectors(language.counts(group), idf)
        return np.rint((rows[:, mixture._ORDER] * mixture._SIGNS[mixture._ORDER].astype(np.float32)).reshape(len(rows), mixture.WIDTH, -1).sum(axis=2) * mixture.ONE)

    def peak(run):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert np.abs(np.array([mixture.hashed(t, idf) for t in batch + odd]) - whole(batch + odd)).max() <= 1
    assert len(odd[-1]) > language._BYTES and not mixture.hashed(b"", idf).any()
    assert peak(lambda: [mixture.hashed(t, idf) for t in batch[:64]]) < 0.1 * peak(lambda: whole(batch[:64]))
    for text, row in zip(batch[:9] + odd, language.counts(batch[:9] + odd)):
        hit, n = language.counted(text)
        assert (hit == np.flatnonzero(row)).all() and (n == row[hit]).all()
