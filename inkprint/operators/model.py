"""Same-author classifier: boosted trees over pair features, with a threshold chosen on validation rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions.lexicon import FAMILY_NAMES
from inkprint.operators import metrics
from inkprint.operators.pairwise import Spec, included


@dataclass(frozen=True)
class TrainingConfig:
    include_statistical: bool = True
    include_tfidf: bool = True
    include_char_ngrams: bool = True
    include_pos_ngrams: bool = True
    include_readability: bool = True
    include_local: bool = True
    include_global: bool = True
    threshold_metric: str = "youden_j"
    threshold_steps: int = 100
    trees: int = 500
    depth: int = 4
    rate: float = 0.05
    subsample: float = 0.8
    column_share: float = 0.3
    least_rows: int = 3
    seed: int = 42

    @property
    def families(self) -> tuple[str, ...]:
        return included({f: getattr(self, f"include_{f}") for f in FAMILY_NAMES})

    def spec(self, vocab_sizes: dict[str, int]) -> Spec:
        """The features of a model; raises where none are switched on."""
        if not (self.include_local or self.include_global):
            raise ValueError("include_local or include_global must be on")
        made = Spec.of(vocab_sizes, self.families, self.include_local, self.include_global)
        if not made.size:
            raise ValueError("no pair features are switched on")
        return made


@dataclass
class Trained:
    model: GBTClassificationModel
    threshold: float
    metrics: dict[str, dict[str, float]]


def fit(train: DataFrame, config: TrainingConfig = TrainingConfig()) -> GBTClassificationModel:
    """Boosted trees of MLlib over the vectors ``features``.  Its column sampling is per node and it has no weight penalties."""
    trees = GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=config.trees, maxDepth=config.depth, stepSize=config.rate,
        subsamplingRate=config.subsample, featureSubsetStrategy=str(config.column_share), minInstancesPerNode=config.least_rows, seed=config.seed,
    )
    return trees.fit(train.withColumn("label", F.col("same").cast("double")))


def predict(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    """Add ``score``: the probability of the same author."""
    made = model.transform(df)
    return made.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def train(features: DataFrame, config: TrainingConfig = TrainingConfig()) -> Trained:
    """Fit on train, choose the threshold on validation, report on test with it; ``features`` has split, same and the vectors."""
    model = fit(features.where("split = 'train'"), config)
    scored = predict(model, features.where("split <> 'train'")).withColumn("label", F.col("same")).select("split", "label", "score").cache()
    grid = metrics.threshold_grid(scored.where("split = 'validation'"), config.threshold_steps)
    best = metrics.best_threshold(grid, config.threshold_metric).first()
    threshold = float(best["threshold"]) if best else 0.5
    report = {split: metrics.evaluate(scored.where(F.col("split") == split), threshold).first().asDict() for split in ("validation", "test")}
    scored.unpersist()
    return Trained(model, threshold, report)
