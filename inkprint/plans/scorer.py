"""A trained bundle as one object: fit, save, load, and score pairs through the plan used in training."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.operators import annotate, audit, metrics, model, pairwise
from inkprint.plans import features
from inkprint.sources import tables


def _vectors(sides: DataFrame, spec: pairwise.Spec) -> DataFrame:
    """pair_id, the vectors ``features`` and the texts of each pair."""
    texts = [F.col(s)[c].alias(f"{c}_{t}") for c in ("normalized", "masked") for s, t in (("a", "text1"), ("b", "text2"))]
    paired = pairwise.vectors(pairwise.paired(sides, [*features.FAMILIES, "normalized", "masked"]), spec)
    return tables.as_vectors(paired.select("pair_id", "features", *texts), f"{tables.shared_folder(sides.sparkSession)}/vectors", "features")


@dataclass
class Scorer:
    model: GBTClassificationModel
    vocabs: dict[str, DataFrame]
    spec: pairwise.Spec
    threshold: float
    report: dict
    config: features.FeatureConfig
    training: model.TrainingConfig
    annotator: features.Annotator = annotate.records

    @classmethod
    def fit(
        cls, pairs: DataFrame, config: features.FeatureConfig = features.FeatureConfig(), training: model.TrainingConfig = model.TrainingConfig(), annotator: features.Annotator = annotate.records
    ) -> Scorer:
        """Audit, featurise and train.  Records, counts and vocabularies are written: each is read by several later steps."""
        kept = audit.audit(pairs, config.least_words, config.most_words)
        records = tables.written(features.annotated(features.masked_sides(kept, config), annotator), "records")
        counts = tables.written(features.counted(records, config, ("normalized", "masked")), "counts")
        vocabs = {f: tables.written(v, f"vocabulary-{f}") for f, v in features.vocabularies(counts, config).items()}
        spec = training.spec({f: v.count() for f, v in vocabs.items()})
        sides = features.sides(counts, features.statistics(records, config), vocabs)
        labelled = _vectors(sides, spec).join(kept.select("pair_id", "split", "same"), "pair_id")
        trained = model.train(labelled, training)
        return cls(trained.model, vocabs, spec, trained.threshold, trained.metrics, config, training, annotator)

    def features(self, pairs: DataFrame) -> DataFrame:
        """pair_id, vectors and texts of pairs, by the vocabularies of the training; no length filter."""
        base = pairs if "split" in pairs.columns else pairs.withColumn("split", F.lit("score"))
        records = tables.written(features.annotated(features.masked_sides(base.select("pair_id", "split", "text1", "text2"), self.config), self.annotator), "records")
        counts = features.counted(records, self.config, ("normalized", "masked"))
        return _vectors(features.sides(counts, features.statistics(records, self.config), self.vocabs), self.spec)

    def score(self, pairs: DataFrame, threshold: float | None = None) -> DataFrame:
        """pair_id, probability, predicted, threshold, label, confidence, and the normalised and masked texts of each pair."""
        t = self.threshold if threshold is None else threshold
        p = F.col("score")
        return model.predict(self.model, self.features(pairs)).select(
            "pair_id",
            p.alias("probability"),
            metrics.decision(p, t).alias("predicted"),
            F.lit(t).alias("threshold"),
            F.when(p >= t, "Same author").otherwise("Different author").alias("label"),
            metrics.confidence(p).alias("confidence"),
            *(F.col(f"{kind}_{side}").alias(f"{kind}_{side}") for kind in ("normalized", "masked") for side in ("text1", "text2")),
        )

    def predict(self, spark: SparkSession, text1: str, text2: str, threshold: float | None = None) -> dict:
        """label, probability, threshold, normalized_text1/2 and masked_text1/2 of one pair; blank texts are refused."""
        if not text1.strip() or not text2.strip():
            raise ValueError("both texts must have content")
        row = self.score(spark.createDataFrame([(0, text1, text2)], "pair_id long, text1 string, text2 string"), threshold).first().asDict()
        return {k: row[k] for k in ("label", "probability", "threshold", "normalized_text1", "normalized_text2", "masked_text1", "masked_text2")}

    def save(self, folder: str) -> None:
        """Model, vocabularies, and JSON files of threshold, features, metrics and settings."""
        self.model.write().overwrite().save(f"{folder}/model")
        for family, vocab in self.vocabs.items():
            vocab.write.mode("overwrite").parquet(f"{folder}/vocabulary/{family}")
        tables.save_json({"threshold": self.threshold}, f"{folder}/threshold.json")
        tables.save_json(self.spec.as_dict() | {"feature_names": self.spec.names()}, f"{folder}/feature_spec.json")
        tables.save_json(self.report, f"{folder}/metrics.json")
        tables.save_json({"features": asdict(self.config), "training": asdict(self.training)}, f"{folder}/training_config.json")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, annotator: features.Annotator = annotate.records) -> Scorer:
        """Raises FileNotFoundError where a part of the bundle is missing."""
        threshold, spec, report, config = (tables.load_json(f"{folder}/{n}.json") for n in ("threshold", "feature_spec", "metrics", "training_config"))
        raw = config["features"]
        made = features.FeatureConfig(**raw | {k: features.terms.TermConfig(**raw[k]) for k in ("lemmas", "chars", "pos")})
        vocabs = {f: spark.read.parquet(f"{folder}/vocabulary/{f}") for f in made.terms}
        kept = pairwise.Spec(spec["sizes"], spec["include_local"], spec["include_global"])
        return cls(GBTClassificationModel.load(f"{folder}/model"), vocabs, kept, threshold["threshold"], report, made, model.TrainingConfig(**config["training"]), annotator)
