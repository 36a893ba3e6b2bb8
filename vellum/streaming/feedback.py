"""Feedback as a stream: windowed outcomes with late rows, and an index that grows batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators.index import save_index
from vellum.sources.stages import FEEDBACK


def feedback_stream(spark: SparkSession, path: str, schema: str = FEEDBACK, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def windowed_outcomes(feedback: DataFrame, time: str = "asked_at", size: str = "1 day", late: str = "3 days") -> DataFrame:
    """(window_start, window_end, status, n, helpful): outcomes by window; on a stream, rows later than `late` are left out.

    The same on a batch, where no row is late.
    """
    df = feedback.withWatermark(time, late) if feedback.isStreaming else feedback
    by = df.where(F.col(time).isNotNull()).groupBy(F.window(time, size).alias("w"), F.coalesce(F.col("metadata.status"), F.lit("unknown")).alias("status"))
    out = by.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("helpful"), F.lit(False))).alias("helpful"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "n", "helpful")


def index_stream(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of new chunks to the index table. A batch that is run again after a failure is written to a folder of its own number."""

    def write(batch: DataFrame, number: int) -> None:
        save_index(batch, f"{path}/batch={number}", mode="overwrite")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
