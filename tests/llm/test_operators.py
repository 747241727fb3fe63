"""The corpus operators on small tables: brute force on the driver's smallest, and odd tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from inkprint.llm import bpe, fertility, language, lm, mixture, quality, queries, repeats, sharding, simhash, sql, topk
from inkprint.llm.components import connected

SF = "/root/testdata/sf0.001"
EXTRA = "kept _n _k _h _rate _source _topic topic rate u row r1 r2 ranges kept_text n_bytes n_removed node key copy tokens n_tokens".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
LONG = "lorem ipsum dolor " * 4000
ODD = [
    (1, "a plain text of some words that is long enough to be kept by the rules", "en", "s", 1, "x", "y", "z"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "s", 0, None, None, None),
    (4, " \t\n", None, "s", 3, None, None, None),
    (5, LONG, "fr", None, len(LONG), None, None, None),
    (6, LONG, "fr", "t", len(LONG), None, None, None),
    (1, "a plain text of some words that is long enough to be kept by the rules", "en", "s", 1, "x", "y", "z"),
    (None, "no id but a text ñ 中文 \U0001f600", "es", "s", 9, None, None, None),
    (None, None, "es", "s", 9, None, None, None),
    (7, "!!! ??? 123", "en", "s", 9, None, None, None),
]


ODD = [(*row[:5], *(f"{c}-{i}" if i % 3 else None for c in EXTRA)) for i, row in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def held():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


VOCABULARIES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
LABELS = "doc_id long, quality int, toxic int, text string"
OPERATORS = {
    "lm": lambda d: lm.score(d, held()),
    "quality": lambda d: quality.classify(d, d.sparkSession.createDataFrame([(1, 1, 0, "x"), (5, 0, 0, "y"), (5, 0, 1, None), (None, 1, 0, None), (7, None, None, None)], LABELS)),
    "shards": lambda d: sharding.shard_rows(d, 4),
    "fertility": lambda d: fertility.judge(d, *VOCABULARIES),
    "bpe": lambda d: bpe.encode_column(d, *VOCABULARIES[1:]),
    "language": lambda d: language.identify(d, held()),
    "mixture": lambda d: mixture.mix(d),
    "repeats": lambda d: repeats.strip_repeats(d, 200),
    "simhash": lambda d: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, none, name):
    rows = OPERATORS[name](odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    assert OPERATORS[name](none).collect() == []


def test_odd_results(odd):
    by = defaultdict(list)
    for r in OPERATORS["repeats"](odd).collect():
        by[r.doc_id].append(r)
    assert by[5][0].n_removed == by[5][0].n_bytes == len(LONG) and by[2][0].n_bytes == 0
    assert {r.lang_pred for r in OPERATORS["language"](odd).collect() if r.doc_id in (2, 3, 4, 7)} == {"und"}
    groups = {r.doc_id: r.component_id for r in OPERATORS["simhash"](odd).collect() if r.doc_id}
    assert groups[2] == groups[3] == groups[4] == 2 and groups[5] == groups[6] == 5
    assert not any(r.kept for r in OPERATORS["quality"](odd).collect() if r.doc_id in (2, 3, 4))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 5, 7, None])


@pytest.mark.parametrize("stage", ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "mixing"])
def test_stages_keep_every_column(spark, odd, none, stage):
    import corpus_pipeline

    made = dict(corpus_pipeline.STAGES)[stage](spark, odd, SF)
    rows = made.collect()
    assert made.columns == odd.columns and (rows or stage == "quality_classifier")
    changed = ("text", "n_chars") if stage == "suffix_array_dedup" else ()
    plain = lambda r: tuple(v for c, v in zip(odd.columns, r) if c not in changed)
    assert not Counter(map(plain, rows)) - Counter(map(plain, ODD))
    if changed:
        assert Counter(map(plain, rows)) == Counter(map(plain, ODD))
        assert {r.text for r in rows if r.doc_id in (5, 6)} == {""} and {r.n_chars for r in rows if r.doc_id == 5} == {0}
    assert dict(corpus_pipeline.STAGES)[stage](spark, none, SF).collect() == []


def test_shards(spark, docs):
    rows = queries.op3_feistel_shards(spark, SF).collect()
    shards = defaultdict(list)
    for r in rows:
        text = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(text) + 16, zlib.crc32(text))
        shards[r.shard].append(r.slot)
    assert len({len(s) for s in shards.values()}) <= 2 and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert sorted(rows) == sorted(queries.op3_feistel_shards(spark, SF).collect())


def test_shards_of_equal_rows(spark):
    rows = [(1, "a")] * 50 + [(2, "b"), (None, None), (3, "a" * 100_000)] + [(4, None)] * 7
    made = [{tuple(r) for r in sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), 4, run=run).collect()} for n, run in ((1, 10_000), (3, 8))]
    assert made[0] == made[1] and len(made[0]) == len(rows)
    assert Counter((r[0], r[2]) for r in made[0]) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {len({r[5] for r in made[0] if r[4] == s}) for s in range(4)} == {15}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 97, 4097])
def test_permutation(spark, n):
    made = sharding.permute(spark.range(n).withColumn("n", F.lit(n).cast("long")), "id", "n", 1, "p")
    assert sorted(r.p for r in made.collect()) == list(range(n))


def test_lm(spark, docs):
    rows = queries.op1_lm_backoff(spark, SF).collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in docs.items() if not out(i) for w in [*t.encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    for r in rows:
        words = [*docs[r.doc_id].encode().lower().split(), None]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (out(r.doc_id), len(words), n, sum(count[w] > 0 for w in words))
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words))
    texts = [([*docs[r.doc_id].encode().lower().split(), None], r.held_out) for r in rows]
    assert [r.score for r in rows] == pytest.approx(_backoff(texts))
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def _backoff(texts: list[tuple[list, bool]]) -> list[float]:
    """Scores by the definition: dictionaries of n-grams, one token after the other, failure arcs followed one by one."""
    start = ("start",)
    one, two, three = Counter(), Counter(), Counter()
    for words, out in texts:
        if not out:
            one.update((w,) for w in words)
            two.update(zip([start, *words], words))
            three.update(zip([start, *words], words, words[1:]))
    n, v = sum(one.values()), len(one)
    count = lambda h: one[(None,)] if h == (start,) else one[h] if len(h) == 1 else two[h]
    is_state = lambda h: not h or (count(h) > 0 if len(h) == 1 else count(h) >= lm.STATE)
    which = lambda c: sum(c >= x for x in lm.RANGES)

    def p(h: tuple, w, k: dict, less: int) -> float:
        if not h:
            return (one[(w,)] - less + 1) / (n - less + v + 1)
        c = count(h)
        lower = p(h[1:], w, k, less)
        arc = (two if len(h) == 1 else three)[(*h, w)]
        pseudo = k[len(h)][which(c)]
        return (arc - less + pseudo * lower) / (c - less + pseudo) if c > less else lower

    def walk(words: list):
        state, before = (start,) if is_state((start,)) else (), start
        for w in words:
            yield state, w
            state = next(h for h in ((before, w), (w,), ()) if is_state(h))
            before = w

    k: dict[int, list[float]] = {1: [lm.PSEUDO[-1]] * (len(lm.RANGES) + 1)}
    for size in (1, 2):  # the pseudo counts of pairs first, then those of triples over them
        sums = [[0.0] * len(lm.PSEUDO) for _ in range(len(lm.RANGES) + 1)]
        for words, out in texts:
            before = [start, *words]
            for i, (state, w) in enumerate(walk(words) if not out else ()):
                h = state if size == 2 else (before[i],)
                if len(h) == size and count(h) > 1:
                    for at, pseudo in enumerate(lm.PSEUDO):
                        sums[which(count(h))][at] += math.log10(p(h, w, {**k, size: [pseudo] * len(sums)}, 1))
        k[size] = [lm.PSEUDO[max(range(len(lm.PSEUDO)), key=lambda at: (row[at], at))] for row in sums]
    return [sum(math.log10(p(h, w, k, 0)) for h, w in walk(words)) for words, _ in texts]


@pytest.mark.parametrize("sizes", [(1 << 16, 1 << 30, 10), (1 << 16, 1 << 14, 10), (1 << 15, 1 << 14, 2)])
def test_lm_is_the_same_for_any_chunks_and_buckets(spark, sizes):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = ({r.doc_id: (r.train_tokens, pytest.approx(r.score)) for r in lm.score(table, held(), *s).collect()} for s in ((1 << 24,), sizes))
    assert one == many


def test_quality(spark, docs):
    """Every row's grades by the definition, from the model that was fitted; and what a fit says of rows it never saw."""
    table, ratings = spark.read.parquet(f"{SF}/documents.parquet"), quality.graded(spark.read.parquet(f"{SF}/labels.parquet"))
    model = quality.train(table, ratings, 3)
    made = quality.Featuriser(model.bits)
    rows = queries.op2_ordinal_quality(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        score = sum(model.weights[i] for i in set(made.features(docs[r.doc_id].encode()).tolist()))
        tails = [1 - 1 / (1 + math.exp(score - cut)) for cut in model.thresholds]
        assert r.expected_grade == pytest.approx(sum(tails)) and r.tail_probability == pytest.approx(tails[-1]) and r.kept == (tails[-1] >= 0.5 and bool(docs[r.doc_id].split()))
    labels = {r.doc_id: r.grade for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").transform(quality.graded).collect()}
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("doc_id").isin(list(labels)))
    seen = lambda i: i % 4 != 1
    fitted = quality.train(big, spark.createDataFrame([(i, g) for i, g in labels.items() if seen(i)], "doc_id long, grade int"), 3)
    new = [(r.tail_probability, labels[r.doc_id] == 2) for r in quality.rate(big, fitted).collect() if not seen(r.doc_id)]
    best, rest = [x for x, good in new if good], [x for x, good in new if not good]
    assert sum((x > y) + (x == y) / 2 for x in best for y in rest) > 0.9 * len(best) * len(rest)


def test_fertility(spark, docs):
    """Base counts, measures, bands and verdict by their definitions, straight from the two libraries."""
    limits, lang = fertility.Bands(), {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=VOCABULARIES[0])
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARIES[1]), special_tokens={})
    want, measured = {}, defaultdict(dict)
    for i, text in docs.items():
        words = text.encode().split()
        runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        seen, lines = set(), 0
        for line in text.split("\n"):
            lines += line in seen and bool(line.encode().split())
            seen.add(line)
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        chars = sum(len(w.decode()) for w in words)
        want[i] = (len(words), chars, sum(c in "#*$%&|<>" for c in text), lines, len(again), failed)
        ids = [x for w in words for x in pieces.encode(w.decode())]
        if ids:
            n, shares = len(ids), [c / len(ids) for c in Counter(ids).values()]
            second = sum(len(other.encode_ordinary(" " + w.decode())) for w in words)
            entropy = -sum(s * math.log2(s) for s in shares) / math.log2(n) if n > 1 else 1.0
            measured[lang[i]][i] = (n, chars / n, chars / max(1, second), sum(map(pieces.is_byte, ids)) / n, entropy)
    verdict = {}
    for rows in measured.values():
        for i, (n, *values) in rows.items():
            out = False
            for at, (value, wide, short, lower, slack) in enumerate(zip(values, (limits.wide, limits.wide, limits.wide, limits.entropy_wide), (limits.short, limits.short, limits.short, limits.entropy_short), (True, True, False, True), (0, 0, limits.byte_slack, 0))):
                bins = sorted(math.floor(r[1 + at] * limits.steps) for r in rows.values())
                low, mid, high = (bins[max(0, math.ceil(q * len(bins)) - 1)] / limits.steps for q in (0.25, 0.5, 0.75))
                half = max(high - low, abs(mid) * limits.least) * (wide + short / math.sqrt(max(n, 1))) + slack
                out |= (lower and value < mid - half) or (at != 3 and value > mid + half)
            verdict[i] = not out
    rejected = 0
    for r in queries.op4_tokeniser_fertility(spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert r.kept == (not r.base_failed and verdict.get(r.doc_id, True))
        rejected += not r.base_failed and not r.kept
    assert rejected


def test_bpe(spark, docs):
    ranks = bpe.read_ranks(VOCABULARIES[1])
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op5_bpe_backtrack(spark, SF).collect():
        ids = other.encode_ordinary(docs[r.doc_id])
        digest = hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest, hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_language(spark, docs):
    """Predictions by the definition from the centroids: trigrams counted one by one, cosines in float64."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in table.collect()}
    rows = queries.op6_centroid_langid(spark, SF).collect()
    new = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in new) >= 0.95 * len(new)
    train = {i: t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 4 != 2}

    def grams(text: str) -> Counter:
        raw = (" " + text.lower() + " ").encode()
        raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in raw)
        return Counter((int.from_bytes(raw[i : i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> 18 for i in range(len(raw) - 2))

    df = Counter(g for t in train.values() for g in set(grams(t)))
    centroids, idf = language.train(table.where(~queries._fold(4)))
    kept = sorted(centroids.collect(), key=lambda r: (r.lang, r.floor))
    assert idf[:50] == pytest.approx([math.log((1 + len(train)) / (1 + df[g])) + 1 for g in range(50)])
    assert {r.lang for r in kept} == {lang[i] for i in train}
    for r in rows[::9]:
        vector = {g: (1 + math.log(n)) * (math.log((1 + len(train)) / (1 + df[g])) + 1) for g, n in grams(docs[r.doc_id]).items()}
        norm = math.sqrt(sum(x * x for x in vector.values())) or 1
        cosines = [sum(c.centre[g] * x for g, x in vector.items()) / norm for c in kept]
        best = max(range(len(kept)), key=cosines.__getitem__)
        assert r.score == pytest.approx(cosines[best], abs=1e-4)
        assert kept[best].lang == r.lang_pred or sorted(cosines)[-2] > cosines[best] - 1e-5
        assert abs(r.score - kept[best].floor) < 1e-4 or r.rejected == (r.score < kept[best].floor)


def test_languages_in_blocks(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = ({r.doc_id: (r.lang_pred, pytest.approx(r.score, abs=1e-5)) for r in language.identify(table, held(), block=n).collect()} for n in (256, 1))
    assert {i: (name, score.expected) for i, (name, score) in many.items()} == one


def test_mixture_tables_agree(spark):
    cells = mixture.materialise(mixture.cells_of(spark.read.parquet(f"{SF}/documents.parquet"), mixture.Targets()), "cells-of")
    few, many = (mixture.rates(cells, mixture.Targets(sweeps=4, local_cells=n)).collect() for n in (10**6, 0))
    one, two = ({tuple(r[:3]): r.rate for r in rows} for rows in (few, many))
    assert one == pytest.approx(two)


def test_mixture(spark, docs):
    """Rates by plain iterative proportional fitting over the cells, decisions by them, and what is told of the targets."""
    rows, targets = queries.op7_rake_mixture(spark, SF).collect(), mixture.Targets()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(t.encode().split()) for i, t in docs.items()}
    cells = Counter()
    for r in rows:
        cells[(r.source, r.lang, r.topic)] += r.n_tokens
    total = sum(cells.values())
    share = lambda at, v: sum(n for k, n in cells.items() if k[at] == v) / total
    aims = []
    for at, margin in enumerate(mixture.MARGINS):
        raw = {v: share(at, v) ** targets.temper[margin] for v in sorted({k[at] for k in cells})}
        aims.append({v: targets.volume * total * x / sum(raw.values()) for v, x in raw.items()})
    rate = {k: targets.volume for k in cells}
    for _ in range(targets.sweeps):
        before = dict(rate)
        for at, aim in enumerate(aims):
            have = Counter()
            for k, n in cells.items():
                have[k[at]] += rate[k] * n
            rate = {k: min(1.0, x * aim[k[at]] / have[k[at]]) if have[k[at]] else x for k, x in rate.items()}
        if max(abs(rate[k] - before[k]) for k in rate) < targets.tolerance:
            break
    u = {r.doc_id: r.u for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", mixture.uniform(71).alias("u")).collect()}
    kept = sum(rate[k] * n for k, n in cells.items())
    for r in rows:
        key = (r.source, r.lang, r.topic)
        assert r.rate == pytest.approx(rate[key], abs=1e-6) and r.kept == (u[r.doc_id] < r.rate)
        for at, margin in enumerate(mixture.MARGINS):
            assert r[f"{margin}_target"] == pytest.approx(aims[at][key[at]] / targets.volume / total)
            assert r[f"{margin}_expected"] == pytest.approx(sum(rate[k] * n for k, n in cells.items() if k[at] == key[at]) / kept, abs=1e-6)
    assert len({r.topic for r in rows}) > 3


def test_topics_learn_from_every_text(spark):
    """Means of the languages, rounds and topics as by plain arithmetic over all of 2,500 texts, however they are dealt."""
    texts = [(i, " ".join(f"{'ab'[i % 2]}{k}{(i * k) % 97}x" for k in range(1, 9)), "xyz"[i % 3], "s") for i in range(2500)]
    table = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    rows = mixture.vectors_of(table)
    held = sorted((r.row, r.lang, bytes(r.vector)) for r in rows.collect())
    vector = np.array([np.frombuffer(v, np.int16) for _, _, v in held], np.float64)
    langs = np.array([x for _, x, _ in held])
    learnt = mixture.learn_topics(rows, mixture.Targets(rounds=40))
    assert set(learnt.langs) == {"x", "y", "z"} and learnt.means[-1] == pytest.approx(vector.mean(axis=0))
    for lang, at in learnt.langs.items():
        assert learnt.means[at] == pytest.approx(vector[langs == lang].mean(axis=0))
    apart = vector - learnt.means[[learnt.langs[x] for x in langs]]
    apart /= np.linalg.norm(apart, axis=1, keepdims=True)
    own = np.argmax(apart @ learnt.centres.T, axis=1)
    for j, centre in enumerate(learnt.centres):
        mean = apart[own == j].sum(axis=0)
        assert centre / mixture.FINE @ mean == pytest.approx(np.linalg.norm(mean), rel=1e-4)
    one, two = ({r.row: r.topic for r in mixture.cells_of(table.repartition(n), mixture.Targets()).collect()} for n in (1, 7))
    assert one == two and len(set(one.values())) > 8


def test_vectors_are_set_apart_once(spark, docs, monkeypatch):
    """Starts and rounds read one written table of every text with a word, which goes afterwards; frequencies are by whole rows of trigrams."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    n, df = language.document_frequency(table.where("text is not null"))
    held = [t.encode() for t in docs.values() if t is not None]
    assert n == len(held) and (df == (language.counts(held) > 0).sum(axis=0)).all()
    rows, made, gone = mixture.vectors_of(table), [], []
    write, drop = mixture.materialise, mixture.discard

    def noted(df, name):
        out = write(df, name)
        made.append((name, out.count(), out))
        return out

    monkeypatch.setattr(mixture, "materialise", noted)
    monkeypatch.setattr(mixture, "discard", lambda df: (gone.append(df), drop(df)))
    learnt = mixture.learn_topics(rows, mixture.Targets())
    assert [x[:2] for x in made] == [("apart", sum(bool(t.split()) for t in held))] and gone == [made[0][2]]
    assert len(learnt.centres) == mixture.Targets().topics


def test_mixture_reports_what_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10, 1.0), ("b", "x", "t", 990, 0.2)], "source string, lang string, topic string, tokens long, rate double")
    told = {(r.margin, r.value): r for r in mixture.report(cells, mixture.Targets(shares={"source": {"a": 0.5, "b": 0.5}})).collect()}
    assert not told["source", "a"].met and told["source", "a"].capped == 1 and told["source", "a"].residual == pytest.approx(10 / 208 - 0.5)
    assert told["lang", "x"].met


@pytest.mark.parametrize("group_bytes", [repeats.GROUP_BYTES, 0])
def test_repeats(spark, docs, group_bytes):
    length = 200
    count = Counter(t[i : i + length] for t in (d.encode() for d in docs.values()) for i in range(len(t) - length + 1))
    for r in repeats.strip_repeats(spark.read.parquet(f"{SF}/documents.parquet"), length, group_bytes=group_bytes).collect():
        text = docs[r.doc_id].encode()
        mark, until = bytearray(len(text)), 0
        for i in range(len(text) - length + 1):
            if count[text[i : i + length]] > 1:
                for j in range(max(i, until), i + length):
                    mark[j] = 1
                until = i + length
        left = bytes(b for b, m in zip(text, mark) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(text), sum(mark), spans, hashlib.sha256(left).hexdigest())


def _print(text: str) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs):
    prints = {i: _print(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = queries.op9_simhash_groups(spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{prints[i]:016x}", find(i)) for i in docs}


def test_keep_one_finds_near_copies(spark):
    words = [f"w{i * 7919 % 1000}x" for i in range(300)]
    near = list(words)
    near[150] = "changed"
    far = [f"z{i * 31 % 977}" for i in range(300)]
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(far)), (4, " ".join(words))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (203, 205)]
    made = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made == {**{i: 1 for i in range(2, 41)}, 101: 100, 205: 200, 203: 200}


def test_topk(spark):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(duck.execute(sql.SQL["op10_nra_topk"]).fetchall())
    assert sorted(tuple(r) for r in queries.op10_nra_topk(spark, SF).collect()) == want


def test_topk_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [2.0]), (None, [1.0, 1.0]), (100, [1e30, -1e30])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("query_id", "score", "rank", "block", "ask", "v", "n", "copy")})
    got = topk.search(table, table.where("vec_id = 0"), 4).orderBy("rank").collect()
    assert [r.vec_id for r in got][1:] == [8, 1, 2] and got[0].vec_id == 100
    assert topk.search(table.where("false"), table.where("false")).collect() == []


def _left(docs: dict, length: int = 200) -> dict:
    """Bytes of each text outside all strings of ``length`` bytes that start at two places."""
    data = {i: t.encode() for i, t in docs.items()}
    count = Counter(t[i : i + length] for t in data.values() for i in range(len(t) - length + 1))
    out = {}
    for name, text in data.items():
        mark, until = bytearray(len(text)), 0
        for i in range(len(text) - length + 1):
            if count[text[i : i + length]] > 1:
                for j in range(max(i, until), i + length):
                    mark[j] = 1
                until = i + length
        out[name] = bytes(b for b, m in zip(text, mark) if not m)
    return out


def test_stages_decide_like_their_operators(spark, docs):
    import corpus_pipeline

    stages, table = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda name: {r.doc_id for r in stages[name](spark, table, SF).collect()}
    assert ids("quality_classifier") == {r.doc_id for r in queries.op2_ordinal_quality(spark, SF).collect() if r.kept}
    assert ids("mixing") == {r.doc_id for r in queries.op7_rake_mixture(spark, SF).collect() if r.kept}
    want = {i: b.decode(errors="ignore") for i, b in _left(docs).items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in stages["suffix_array_dedup"](spark, table, SF).collect()} == {i: (t, len(t)) for i, t in want.items()}


def test_pipeline(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert made.columns == table.columns
        before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, made))
        assert set(after) <= set(before)
        if name in ("quality_classifier", "mixing"):
            assert all(before[i] == t for i, t in after.items())
        docs = made
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == set(after)
    assert all(len(r.ids) == r.n_tokens and r.decoded_sha256 == hashlib.sha256(after[r.doc_id].encode()).hexdigest() for r in rows)
