"""Stage tables and the feedback log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEEDBACK = (
    "asked_at timestamp, question string, answer string, helpful boolean, remark string, "
    "metadata struct<class: string, subject: string, lang: string, status: string, rejection_type: string, grounding_score: double, sent_at: string>"
)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Write one stage's rows as parquet, ORC, JSON lines or CSV."""
    if fmt not in ("parquet", "orc", "json", "csv"):
        raise ValueError(f"unknown format {fmt}")
    writer = df.write.mode(mode).format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_stage(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def normalized_feedback(raw: DataFrame) -> DataFrame:
    """Feedback as it is logged: no answer is REJECTED, no remark is '', an empty type and a score of 0 are NULL, texts are trimmed."""
    m = F.col("metadata")
    score, kind = F.nullif(m["grounding_score"], F.lit(0.0)), F.nullif(m["rejection_type"], F.lit(""))
    return raw.withColumns({
        "answer": F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.lit("REJECTED")),
        "remark": F.coalesce(F.trim("remark"), F.lit("")),
        "metadata": F.when(m.isNotNull(), m.withField("grounding_score", score).withField("rejection_type", kind)),
    })


def append_feedback(feedback: DataFrame, path: str) -> bool:
    """Append feedback to the log; a failure is told, not raised."""
    try:
        normalized_feedback(feedback).write.mode("append").json(path)
    except Exception:  # noqa: BLE001
        return False
    return True
