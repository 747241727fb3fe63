"""Evaluation of scored labels (label 0/1, score): confusion counts, rates, ROC-AUC, threshold search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATES = ("accuracy", "precision", "recall", "f1", "balanced_accuracy", "specificity", "youden_j")


def confusion(threshold: Column | float) -> list[Column]:
    hit = F.col("score") >= threshold
    cell = lambda test, name: F.count_if(test).alias(name)
    one = F.col("label") == 1
    return [cell(~hit & ~one, "tn"), cell(hit & ~one, "fp"), cell(~hit & one, "fn"), cell(hit & one, "tp")]


def rates(df: DataFrame, digits: int | None = 5) -> DataFrame:
    """Add the rates that follow from tn, fp, fn, tp; a zero denominator gives 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recall, specificity = div(tp, tp + fn), div(tn, tn + fp)
    made = {
        "accuracy": div(tp + tn, tn + fp + fn + tp),
        "precision": div(tp, tp + fp),
        "recall": recall,
        "f1": div(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (recall + specificity) / 2,
        "specificity": specificity,
        "youden_j": recall + specificity - 1,
    }
    return df.withColumns({k: F.bround(v, digits) if digits is not None else v for k, v in made.items()})


#: Score cells of the ranking; sums of whole cells are all that one task sees at once.
CELLS = 4096


def roc_auc(scored: DataFrame, digits: int | None = 5, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by average ranks, ties halved; with ``by``, of each group.

    Scores are counted first, so what is ranked is the distinct scores.  These
    are dealt into cells by value: negatives of lower cells come from sums over
    cells (``CELLS`` + 2 rows at most), those of the same cell from a window in it.
    """
    keys = by or []
    counts = scored.groupBy(*keys, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    cell = F.greatest(F.lit(-1), F.least(F.lit(CELLS), F.floor(F.col("score") * CELLS))).cast("int")
    dealt = counts.withColumn("cell", cell)
    upto = lambda *k, order: Window.partitionBy(*k).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy(*keys, "cell").agg(F.sum("neg").alias("n"))
    lower = cells.select(*keys, "cell", F.coalesce(F.sum("n").over(upto(*keys, order="cell")), F.lit(0)).alias("lower"))
    ranked = dealt.withColumn("own", F.coalesce(F.sum("neg").over(upto(*keys, "cell", order="score")), F.lit(0))).join(lower, [*keys, "cell"])
    below = F.col("lower") + F.col("own")
    total = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    auc = F.try_divide(F.col("u"), F.col("p").cast("double") * F.col("n"))
    return total.select(*keys, (F.bround(auc, digits) if digits is not None else auc).alias("roc_auc"))


def threshold_grid(scored: DataFrame, step: int = 100, digits: int = 5) -> DataFrame:
    """Counts and rates at each of the thresholds 0, 1/step, ..., 1.

    Scores are first counted by the grid cell they fall in: at most step + 2
    rows meet the grid, whatever the number of scores.
    """
    grid = scored.sparkSession.range(step + 1).select((F.col("id") / step).alias("threshold"))
    # the highest grid point that a score reaches
    cell = F.least(F.lit(step), F.floor(F.col("score") * step + 1)).cast("int")
    reached = F.when(F.col("score") >= cell / F.lit(step), cell).when(F.col("score") >= (cell - 1) / F.lit(step), cell - 1).otherwise(cell - 2)
    counts = scored.withColumn("cell", reached).groupBy("cell").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    met = grid.join(F.broadcast(counts), F.lit(True), "left")
    over = F.col("cell") >= F.round(F.col("threshold") * step)
    cells = [F.coalesce(F.sum(F.when(over == flag, F.col(side))), F.lit(0)).alias(name) for flag, side, name in ((False, "neg", "tn"), (True, "neg", "fp"), (False, "pos", "fn"), (True, "pos", "tp"))]
    return rates(met.groupBy("threshold").agg(*cells), digits)


def best_threshold(grid: DataFrame, metric: str = "youden_j") -> DataFrame:
    """The grid row with the best rounded metric: 0.5 wins its ties, then the lowest threshold."""
    return grid.orderBy(F.desc(metric), F.desc((F.col("threshold") == 0.5).cast("int")), "threshold").limit(1)


def evaluate(scored: DataFrame, threshold: float, digits: int = 5) -> DataFrame:
    """One row: threshold, counts, rates and roc_auc."""
    at = rates(scored.agg(*confusion(F.lit(threshold))), digits)
    return at.join(roc_auc(scored, digits), F.lit(True)).withColumn("threshold", F.lit(threshold))


def app_metrics(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """f1, youden_j (recomputed from counts) and auc_roc as a service shows them, beside the columns ``keep``."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    sensitivity = F.coalesce(F.try_divide(tp, tp + fn), F.col("recall"), F.lit(0.0))
    return df.select(*(keep or []), "f1", F.bround(sensitivity + F.coalesce(F.try_divide(tn, tn + fp), F.lit(0.0)) - 1, 5).alias("youden_j"), F.col("roc_auc").alias("auc_roc"))


def confidence(p: Column) -> Column:
    far = lambda hi, lo: (p >= hi) | (p <= lo)
    return F.when(far(0.9, 0.1), "Surely").when(far(0.75, 0.25), "Very Likely").when(far(0.6, 0.4), "Likely").otherwise("Uncertain")


def decision(p: Column, threshold: Column | float) -> Column:
    return F.when(p >= threshold, 1).otherwise(0)


def display(p: Column) -> dict[str, Column]:
    """Clamped probability as hue, angle and percentage, rounded from their decimal form of 16 places."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    r = lambda value, digits: F.round(value.cast("string").cast("decimal(24,16)"), digits).cast("double")
    return {"hue": 8 + clamped * 126, "angle": r(clamped * 360, 2), "percent": r(clamped * 100, 1)}
