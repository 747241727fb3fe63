"""Training, the saved bundle and scoring go through one plan."""

import pytest

from inkprint.operators import annotate, model, terms
from inkprint.plans import features, fixtures
from inkprint.plans.scorer import Scorer

SMALL = features.FeatureConfig(least_words=50, lemmas=terms.TermConfig("tfidf", max_features=300), chars=terms.TermConfig("char_ngrams", max_features=300), pos=terms.TermConfig("pos_ngrams", max_features=100))


def test_scorer_round_trip(spark, tmp_path):
    pairs = fixtures.pairs(spark, "/root/testdata/sf0.001")
    made = Scorer.fit(pairs, SMALL, model.TrainingConfig(trees=2, include_pos_ngrams=False))
    assert made.spec.include_local and "pos_ngrams" not in made.spec.sizes and made.spec.size == 2 * (74 + 300 + 300 + 4) + 9
    assert 0 <= made.threshold <= 1 and set(made.report) == {"validation", "test"}
    made.save(str(tmp_path))
    loaded = Scorer.load(spark, str(tmp_path))
    assert (loaded.spec, loaded.training) == (made.spec, made.training)
    batch = pairs.orderBy("pair_id").limit(3)
    before = {r.pair_id: r.probability for r in made.score(batch).collect()}
    after = {r.pair_id: r.probability for r in loaded.score(batch).collect()}
    assert before == pytest.approx(after) and len(before) == 3
    row = pairs.orderBy("pair_id").first()
    told = loaded.predict(spark, row.text1, row.text2)
    assert list(told) == ["label", "probability", "threshold", "normalized_text1", "normalized_text2", "masked_text1", "masked_text2"]
    assert told["probability"] == pytest.approx(before[row.pair_id])
    with pytest.raises(ValueError):
        loaded.predict(spark, " ", "x")
    with pytest.raises(FileNotFoundError):
        Scorer.load(spark, str(tmp_path / "none"))


def _loader():
    """Makes a stand-in for a model: words, one sentence, no chunks, and an entity where "Ann" stands first.  All of it is local, so that workers needn't import this file."""

    def load():
        from types import SimpleNamespace as Made

        def parsed(text):
            tokens = [Made(text=w, lower_=w.lower(), lemma_=w.lower(), pos_="NOUN", dep_="dep", is_punct=False, is_space=False) for w in text.split()]
            ents = [Made(start_char=text.index("Ann"), end_char=text.index("Ann") + 3, label_="PERSON")] if "Ann" in text else []

            class Doc(list):
                sents = [Made(start=0, end=len(tokens))]

                @property
                def noun_chunks(self):
                    raise NotImplementedError

            made = Doc(tokens)
            made.ents = ents
            return made

        return Made(pipe=lambda texts, batch_size: map(parsed, texts))

    return load


def test_model_annotator_masks(spark):
    annotator = lambda df: annotate.model_records(df, _loader())
    masked, record = features.mask_text(spark, "so Ann went", annotator)
    assert masked == "so <PERSON> went" and [t.text for t in record["tokens"]] == ["so", "Ann", "went"] and record["chunks"] == []
    pairs = spark.createDataFrame([(1, "train", "Ann saw x", "no one", 1), (2, "test", "y Ann", "Ann Ann", 0)], "pair_id long, split string, text1 string, text2 string, same int")
    made = features.annotated(features.masked_sides(pairs), annotator)
    assert {(r.pair_id, r.side): r.masked for r in made.collect()} == {(1, "text1"): "<PERSON> saw x", (1, "text2"): "no one", (2, "text1"): "y <PERSON>", (2, "text2"): "<PERSON> Ann"}
    rows = {r.split: (r.num_rows, r.PERSON_count) for r in annotate.entity_summary(made).collect()}
    assert rows == {"train": (1, 1), "test": (1, 2)}


def test_summaries(spark):
    pairs = fixtures.pairs(spark, "/root/testdata/sf0.001")
    records = features.annotated(features.masked_sides(pairs)).persist()
    counts = features.counted(records, SMALL).persist()
    vocabs = features.vocabularies(counts, SMALL)
    rows = {r.split: r for r in terms.summary(features.weighted(counts, vocabs), vocabs).collect()}
    assert set(rows) == {"train", "validation", "test"} and sum(r.num_rows for r in rows.values()) == pairs.count()
    assert rows["train"].char_ngrams_vocabulary_size == 300 and 0 < rows["test"].text1_tfidf_density <= 300


def test_columns_are_annotated_once_and_corpora_kept(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "train", "Ann saw trees", "no one", 1)], "pair_id long, split string, text1 string, text2 string, same int")
    folder = str(tmp_path)
    made = features.annotate_columns(pairs, f"{folder}/records").collect()
    again = features.annotate_columns(pairs.withColumn("text1", features.F.lit("changed")), f"{folder}/records")
    assert sorted(again.collect()) == sorted(made) and len(made) == 2
    counts = features.counted(again, SMALL)
    features.save_artifacts(again, features.vocabularies(counts, SMALL), folder)
    rows = {r.side: r for r in spark.read.parquet(f"{folder}/corpora").collect()}
    assert rows["text1"].char_ngrams == "Ann saw tree rees" and rows["text1"].pos_ngrams == "PROPN VERB NOUN" and rows["text1"].tfidf == "ann saw tree"
