"""Unit goldens of the text functions."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkprint.functions import lexicon, masking, text
from inkprint.operators import annotate, audit, metrics, model, reduce, sparse, stats, terms
from inkprint.plans import catalogue, fixtures

SINGLE = [
    ("url", "see (https://a.b/c?x=1). ok", "see (<URL>). ok"),
    ("date", "marketing 12 people", "<DATE> people"),
    ("date", "May 5, 2020.", "<DATE>."),
    ("date", "2020-1-2", "<DATE>"),
    ("time", "at 10:30 today", "at <TIME>today"),
    ("time", "at 10:30pm.", "at <TIME>."),
    ("currency", "cost $5.00 now", "cost $5.00 now"),
    ("currency", "costUS$5.00 now", "costUS<CURRENCY> now"),
    ("currency", "5 dollars", "<CURRENCY>"),
    ("address", "12 people on the way home", "<ADDRESS> home"),
    ("address", "221 Baker St. London", "<ADDRESS> London"),
    ("org_suffix", "Acme Inc. said; Foo L.L.C. bar; S.A. x; s.a.b", "Acme <ORG_SUFFIX>. said; Foo L.L.C. bar; S.A. x; <ORG_SUFFIX>b"),
    ("number", "v1 1.5 2020/01 3rd 1,000.5", "v1 <NUMBER> <NUMBER> 3rd <NUMBER>"),
]
CHAIN = [
    ("cost $5.00 now", "cost $<NUMBER> now"),
    ("2020-1-2 3/4/21", "<DATE> <DATE>"),
    ("mail a.b+c@d-e.co.uk, or WWW.Foo.com/x_y.", "mail <EMAIL>, or <URL>."),
    ("On 12 March 2021 at 7:05:09 PM we paid 1,200.50 EUR at 10 Downing Street.", "On <DATE> at <TIME> we paid <CURRENCY> at <ADDRESS>"),
    ("", ""),
]


def _one(spark, value, made):
    return spark.createDataFrame([(value,)], "x string").select(made(F.col("x"))).first()[0]


@pytest.mark.parametrize("rule,before,after", SINGLE)
def test_single_rule(spark, rule, before, after):
    assert _one(spark, before, lambda c: masking.mask(c, rule)) == after


@pytest.mark.parametrize("before,after", CHAIN)
def test_chain(spark, before, after):
    assert _one(spark, before, masking.mask_all) == after


def test_chain_equals_python(spark):
    value = " ".join(b for _, b, _ in SINGLE) + " " + " ".join(b for b, _ in CHAIN)
    want = value
    for rule, pattern in masking.RULES.items():
        flags = re.I if "i" in pattern[: pattern.index(")")] else 0
        want = re.sub(pattern[pattern.index(")") + 1 :], masking.placeholder(rule), want, flags=flags)
    assert _one(spark, value, masking.mask_all) == want


ASCII = "coñ Ñco. ñ12 12é \x0bco a\u00a0co. Acme Inc. at 10:30\x0bpm ümail a@b.co \u212aelvin\u212aco 5\u212a co\u017f"


def test_ascii_edges_are_duckdbs(spark):
    for rule in masking.RULES:
        sql = catalogue._re2(rule)
        want = duckdb.execute(f"select regexp_replace($1, '{sql}', '{masking.placeholder(rule)}', 'g'), len(regexp_extract_all($1, '{sql}'))", [ASCII]).fetchone()
        assert (_one(spark, ASCII, lambda c: masking.mask(c, rule, ascii=True)), _one(spark, ASCII, lambda c: masking.count(c, rule, ascii=True))) == want
    assert _one(spark, "Ñco coñ ñ12", masking.mask_all) == "Ñco coñ ñ12"
    assert _one(spark, "Ñco coñ ñ12", lambda c: masking.mask_all(c, ascii=True)) == "Ñ<ORG_SUFFIX> <ORG_SUFFIX>ñ ñ<NUMBER>"


def test_display_rounds_the_decimal_form(spark):
    rows = spark.createDataFrame([(0.0045,), (2.0,), (0.5,)], "p double").select(*(c.alias(n) for n, c in metrics.display(F.col("p")).items())).collect()
    assert [(r.angle, r.percent) for r in rows] == [(1.62, 0.5), (360.0, 100.0), (180.0, 50.0)]


def test_whitespace_is_pythons(spark):
    value = "a b c\x85d\x1ce"
    assert _one(spark, value, text.words) == value.split()
    assert _one(spark, " \x1c a b  ", text.strip) == "a b"


def test_normalize_order(spark):
    value = "“caf&eacute;”\r\n\r\n\r\n\r\n $\\beta$ and   $x+1$ \x07 end "
    assert _one(spark, value, text.normalize) == '"café"\n\n\nbeta and <MATH> end'
    assert _one(spark, None, text.normalize) == ""


def test_char_grams(spark):
    assert _one(spark, "writing abc", terms.char_grams) == ["writ", "riti", "itin", "ting", "abc"]
    assert _one(spark, " ", terms.char_grams) == []


def test_safe_rate(spark):
    got = spark.sql("select 1 as a, 16 as b, 0 as z").select(text.safe_rate(F.col("a"), F.col("b")), text.safe_rate(F.col("a"), F.col("z"))).first()
    assert tuple(got) == (0.062, 0.0)


def test_symmetric_dedup_keeps_first_and_both_labels(spark):
    rows = [(1, "test", "A", "B", 1), (2, "train", "B", "A", 1), (3, "train", "A", "B", 0), (4, "train", "A", "B", 1)]
    pairs = spark.createDataFrame(rows, "pair_id long, split string, text1 string, text2 string, same int")
    assert sorted(r.pair_id for r in audit.dedup(pairs).collect()) == [2, 3]
    assert audit.duplicates(pairs).first()[0] == 2


def test_validity(spark):
    rows = [(1, "a", "b", 1), (2, "  ", "b", 1), (3, None, "b", 0), (4, "a", "b", 2), (5, "a", "b", None)]
    pairs = spark.createDataFrame(rows, "pair_id int, text1 string, text2 string, same int")
    assert [r.pair_id for r in audit.valid(pairs).collect()] == [1]


@pytest.mark.parametrize(
    "counts,rates",
    [((2858, 546, 1077, 2963), (0.78197, 0.8444, 0.73342, 0.785, 0.78651, 0.8396, 0.57302)), ((3009, 512, 1039, 2826), (0.79001, 0.84661, 0.73118, 0.78467, 0.79288, 0.85459, 0.58576))],
)
def test_published_rates(spark, counts, rates):
    row = metrics.rates(spark.createDataFrame([counts], "tn long, fp long, fn long, tp long")).first()
    assert tuple(row[r] for r in metrics.RATES) == rates


def test_best_threshold_prefers_half(spark):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.1)], "label int, score double")
    assert metrics.best_threshold(metrics.threshold_grid(scored)).first()["threshold"] == 0.5


def test_empty_metrics(spark):
    assert metrics.roc_auc(spark.createDataFrame([], "label int, score double")).first()[0] is None


def test_lexicon(tmp_path):
    words = lexicon.function_words()
    assert len(words) == len(set(words)) and {"the", "of", "myself", "couldn't"} <= set(words)
    (tmp_path / "words").write_text("Whence\n\nwhence\nthus \n")
    assert lexicon.function_words(str(tmp_path / "words")) == ("whence", "thus")


def test_ecdf_and_auc_over_cells(spark, monkeypatch):
    values = [3, 3, 9000, 1, 5000, 3, 12, 9000]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    for cell, run in ((4096, 10_000), (2, 2)):
        monkeypatch.setattr(audit, "CELL", cell)
        monkeypatch.setattr(audit, "RUN", run)
        assert sorted((r.x, r.y) for r in audit.ecdf(df, F.col("v")).collect()) == [(x, (i + 1) / 8) for i, x in enumerate(sorted(values))]
    scored = spark.createDataFrame([(1, 0.9), (0, 0.9), (0, 1.5), (1, 0.2), (1, -0.5), (0, -0.5), (1, 0.20001)], "label int, score double")
    rows = scored.collect()
    pairs = [(p.score > n.score) + (p.score == n.score) / 2 for p in rows for n in rows if p.label == 1 and n.label == 0]
    assert metrics.roc_auc(scored, None).first()[0] == pytest.approx(sum(pairs) / len(pairs))
    both = metrics.roc_auc(scored.withColumn("g", F.lit("x")).unionByName(scored.withColumn("g", F.lit("y"))), None, ["g"]).collect()
    assert [r.roc_auc for r in both] == [pytest.approx(sum(pairs) / len(pairs))] * 2


GOLDEN = {
    "avg_sentence_length_words": 4.0, "avg_function_words_per_sentence": 1.5, "punctuation_rate": 0.2, "avg_word_length": 3.5, "function_word_rate": 0.375,
    "phrase_noun_phrase_rate": 0.75, "phrase_prepositional_phrase_rate": 0.25, "phrase_clausal_phrase_rate": 0.0, "pos_noun_rate": 0.25, "pos_verb_rate": 0.25,
    "pos_punctuation_rate": 0.0, "dep_root_rate": 0.25, "dep_nominal_subject_rate": 0.25,
}


def test_golden_statistics(spark):
    made = stats.document_statistics(fixtures.golden_record(spark), ["id"], ("the", "it", "into"))
    rows = {r.id: r for r in made.collect()}
    assert made.columns == ["id", *stats.NAMES] and len(stats.NAMES) == 74
    assert {n: rows[1][n] for n in GOLDEN} == GOLDEN and all(rows[2][n] == 0 for n in stats.NAMES)


SPLICED = [
    (1, "Ann met Bob Lee in Rome", [(8, 15, "PERSON"), (0, 3, "PERSON"), (12, 15, "ORG"), (19, 23, "GPE")], "<PERSON> met <PERSON> in <GPE>"),
    (2, "at the Louvre by the Nile", [(7, 13, "FAC"), (17, 25, "LOC"), (0, 2, "NOTHING")], "at the <FACILITY> by <LOCATION>"),
    (3, "nothing here", [], "nothing here"),
]


def test_entities(spark):
    df = spark.createDataFrame([(*r[:3], "all") for r in SPLICED], f"pair_id int, text string, ents array<{annotate.ENTITY}>, split string")
    assert [r[0] for r in df.orderBy("pair_id").select(annotate.entity_mask(F.col("text"), F.col("ents"))).collect()] == [r[3] for r in SPLICED]
    assert {r.label: r.n for r in annotate.entity_counts(df).collect()} == {"PERSON": 2, "ORG": 1, "GPE": 1, "FAC": 1, "LOC": 1}
    row = annotate.entity_summary(df).first()
    assert (row.num_rows, row.PERSON_count, row.FAC_count, row.DATE_count) == (3, 2, 1, 0)


def test_math_and_html(spark):
    math = {r"$\alpha$": "alpha", r"escaped \$5 and $6": r"escaped \$5 and $6", r"$\unknown$": "<MATH>", "": "", "no math": "no math"}
    for value, want in math.items():
        assert _one(spark, value, text.math_spans) == want
    assert _one(spark, "a &amp; b &lt;c&gt; e\u0301", text.normalize) == "a & b <c> \u00e9"


def test_records_of_many_rows(spark):
    """Rows don't run into each other, and equal tokens get equal tags wherever they stand."""
    texts = ["He runs. <URL> dogs barked 3 times!", "", "The Ñandú saw", None, "Dogs", ". .", "of it", "ly xly abcly Ünlich's naïveté 5ing ßßßed"]
    rows = annotate.records(spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "i int, text string").coalesce(1)).orderBy("i").collect()
    assert len(rows) == 320 and all(tuple(r)[2:] == tuple(rows[i % 8])[2:] for i, r in enumerate(rows))
    assert [[(s.start, s.end) for s in r.sentences] for r in rows[:7]] == [[(0, 3), (3, 9)], [], [(0, 3)], [], [(0, 1)], [(0, 1), (1, 2)], [(0, 2)]]
    assert [[(s.start, s.end) for s in r.chunks] for r in rows[:7]] == [[(0, 1), (4, 5), (7, 8)], [], [(1, 2)], [], [(0, 1)], [], [(1, 2)]]
    assert [(t.text, t.lemma, t.pos) for t in rows[7].tokens] == [
        ("ly", "ly", "NOUN"), ("xly", "xly", "NOUN"), ("abcly", "abcly", "ADV"), ("Ünlich's", "ünlich's", "PROPN"), ("naïveté", "naïveté", "NOUN"), ("5", "5", "NUM"), ("ing", "ing", "NOUN"), ("ßßßed", "ßßß", "VERB"),
    ]


def test_rules_and_empty_record(spark):
    row = annotate.records(spark.createDataFrame([("He runs. <URL> dogs barked 3 times!",)], "text string")).first()
    assert [(t.text, t.lemma, t.pos) for t in row.tokens] == [
        ("He", "he", "PRON"), ("runs", "run", "VERB"), (".", ".", "PUNCT"), ("<URL>", "<url>", "X"), ("dogs", "dog", "NOUN"), ("barked", "bark", "VERB"), ("3", "3", "NUM"), ("times", "time", "NOUN"), ("!", "!", "PUNCT"),
    ]
    assert [(s.start, s.end) for s in row.sentences] == [(0, 3), (3, 9)]
    empty = annotate.records(spark.createDataFrame([(None,)], "text string"))
    assert tuple(empty.first())[1:] == ([], [], [], []) == tuple(spark.range(1).select(*annotate.empty_record().values()).first())


def test_sparse_agrees_with_long_form(spark):
    docs = spark.createDataFrame([(1, "ab abc abcd", "x"), (2, "abcde ab", "y"), (3, "", "x"), (4, None, "x")], "id int, text string, side string")
    rows = docs.select("id", sparse.gram_counts(F.col("text")).alias("c"))
    long = terms.term_counts(docs.na.fill(""), terms.char_grams(F.col("text")), ["id"])
    assert sorted(sparse.long_counts(rows, "c", ["id"]).collect()) == sorted(long.collect())
    config = terms.TermConfig("char_ngrams", min_df=1, max_features=None)
    vocab = terms.vocabulary(long, 4, config)
    want = sorted((r.id, r.term_idx, round(r.weight, 12)) for r in terms.tfidf(long, vocab, ["id"]).collect())
    for most in (sparse.MOST_TERMS, 0):
        sparse.MOST_TERMS, kept = most, sparse.MOST_TERMS
        made = sparse.weights(rows, "c", vocab, "w", ["id"])
        sparse.MOST_TERMS = kept
        assert made.count() == 4 and sorted((r.id, r.term_idx, round(r.weight, 12)) for r in sparse.long_weights(made, "w", ["id"]).collect()) == want


def test_results_are_made_few_rows_at_a_time():
    """What a function of rows holds doesn't grow with the batch it gets."""
    text = pa.array(["ab abc abcd"] * 1000 + [None])
    seen = []
    made = sparse.pieces(lambda x: seen.append(len(x)) or x, iter([text, text[:0], (text[:3],)]))
    assert sum(len(x) for x in made) == 1004 and max(seen) == sparse.ROWS


def test_svd_equals_dense_decomposition(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(60, 12)) * (rng.random((60, 12)) < 0.5) * np.arange(12, 0, -1)
    df = spark.createDataFrame([("train", *[{"idx": np.flatnonzero(r).tolist(), "weight": r[r != 0].tolist()}] * 2) for r in a], "split string, tfidf struct<idx:array<int>,weight:array<double>>, pos_ngrams struct<idx:array<int>,weight:array<double>>")
    config = reduce.ReductionConfig(tfidf_components=4, pos_ngrams_components=100, passes=40)
    sides, summary, made = reduce.reduce_families(df, {"tfidf": 12, "pos_ngrams": 12}, config)
    singular, right = np.linalg.svd(a)[1:]
    assert made["tfidf"].singular == pytest.approx(singular[:4], rel=1e-6) and np.abs(np.diag(right[:4] @ made["tfidf"].components)) == pytest.approx(np.ones(4), abs=1e-5)
    shown = np.array([r.tfidf_svd.weight for r in sides.collect()])
    assert shown == pytest.approx(a @ made["tfidf"].components) and "tfidf" not in sides.columns
    want = (a @ right[:4].T).var(axis=0).sum() / a.var(axis=0).sum()
    rows = {r.family: r for r in summary.collect()}
    assert rows["tfidf"].explained_variance_ratio_sum == pytest.approx(want, abs=1e-5) and rows["pos_ngrams"].reduced_components == 11
    assert reduce.matches("tfidf", "tfidf_00001") and reduce.matches("pos_ngrams", "pos_2_3_tfidf_1") and not reduce.matches("char_ngrams", "charming")


def test_reductions_round_trip(spark, tmp_path):
    made = {"tfidf": reduce.Reduction(np.arange(6.0).reshape(3, 2), np.array([2.0, 1.0]), 0.5, 3)}
    reduce.save_reductions(spark, made, str(tmp_path))
    back = reduce.load_reductions(spark, str(tmp_path), ("tfidf",))["tfidf"]
    assert (back.components == made["tfidf"].components).all() and (back.singular == [2, 1]).all() and (back.explained, back.features) == (0.5, 3)


def test_family_switches():
    sizes = {"tfidf": 3, "char_ngrams": 2, "pos_ngrams": 1}
    spec = model.TrainingConfig(include_char_ngrams=False, include_readability=False).spec(sizes)
    assert spec.sizes == {"statistical": 74, "tfidf": 3, "pos_ngrams": 1} and spec.distances == ("tfidf", "pos_ngrams", "scalar")
    names = spec.names()
    assert len(names) == spec.size == 2 * 78 + 9 and names[148:151] == ["tfidf_00000_abs_diff", "tfidf_00000_product", "tfidf_00001_abs_diff"] and names[-1] == "scalar_l2_distance"
    assert model.TrainingConfig(include_local=False).spec(sizes).size == 12
    for config in (model.TrainingConfig(include_local=False, include_global=False), model.TrainingConfig(**{f"include_{f}": False for f in lexicon.FAMILY_NAMES})):
        with pytest.raises(ValueError):
            config.spec(sizes)
