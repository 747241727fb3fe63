"""Structured Streaming: the stateless stages over a stream of texts or pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkprint.functions.masking import mask_all
from inkprint.functions.text import normalize
from inkprint.plans.scorer import Scorer


def masked_stream(texts: DataFrame, column: str = "text", ascii: bool = False) -> DataFrame:
    """Normalised and masked texts of a stream; no state is held."""
    return texts.withColumn(column, normalize(F.col(column))).withColumn(column, mask_all(F.col(column), ascii))


def score_stream(pairs: DataFrame, scorer: Scorer, sink: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and append it as Parquet.

    The batch number is part of the path, so a batch that is run again after a
    failure overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        scorer.score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
