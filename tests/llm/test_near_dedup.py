"""The near-duplicate stage against brute force over exact shingle-set similarities."""

import random

import numpy as np

from inkprint.llm import simhash


def _shingles(text: str) -> set:
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _similarity(a: str, b: str) -> float:
    x, y = _shingles(a), _shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def _kept(texts: dict[int, str], least: float = 0.8) -> set[int]:
    """Smallest ids of the components of all pairs at least so similar."""
    ids, root = sorted(texts), {i: i for i in texts}
    for i in ids:
        for j in ids:
            if i < j and root[i] != root[j] and _similarity(texts[i], texts[j]) >= least:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def _body(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def _made(spark, texts: dict[int, str]) -> set[int]:
    return {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


def test_shared_padding_is_no_copy(spark):
    rng = random.Random(1)
    texts = {}
    for padding in (["-"] * 400, ["row", "end", "|"] * 400):
        for _ in range(3):
            texts[len(texts)] = " ".join(_body(rng, 300) + padding)
    assert max(_similarity(texts[i], texts[j]) for i in texts for j in texts if i < j) < 0.1
    assert _made(spark, texts) == _kept(texts) == set(texts)


def test_similarity_at_the_limit_decides(spark):
    rng = random.Random(2)
    texts = {}
    for n, steps in ((100, 12), (300, 16), (3000, 4)):
        for step in range(steps):
            body = _body(rng, n + 4)
            share = 0.78 + 0.07 * step / (steps - 1)
            changed = round(n * (1 - share) / (1 + share))
            texts[len(texts)] = " ".join(body)
            texts[len(texts)] = " ".join(body[: n + 4 - changed] + _body(rng, changed))
    body = _body(rng, 300)
    texts |= {1000: " ".join(body), 1001: " ".join(body + ["-"] * 400), 1002: " ".join(body + ["row", "end", "|"] * 130)}
    assert _similarity(texts[1000], texts[1001]) > 0.97
    assert len(texts) // 2 < len(_kept(texts)) < len(texts) - 10
    assert _made(spark, texts) == _kept(texts)


def test_prefilters_lose_no_pair_at_the_limit():
    similar, rng = simhash.Similar(), np.random.default_rng(3)
    for size in (5, 100, 240, 1000, 5000):
        for _ in range(400 if size < 1000 else 60):
            every = rng.integers(0, 2**64, size, np.uint64, endpoint=False)
            a, b = every[: size * 9 // 10], np.concatenate((every[: size * 8 // 10], every[size * 9 // 10 :]))
            assert int(simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= similar.radius
            assert float(simhash.similarity(simhash.sketch(a), simhash.sketch(b))) >= similar.least - similar.slack


def test_alike():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sets = [np.unique(rng.choice(20, rng.integers(1, 20))).astype(np.uint64) for _ in range(60)]
        linked = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8  # noqa: E731, B023
        a, b = simhash.alike(sets, 0.8)
        assert all(linked(i, j) for i, j in zip(a, b))
        root = simhash._forest(60, a, b)
        assert all(root[i] == root[j] for i in range(60) for j in range(i) if linked(i, j))
