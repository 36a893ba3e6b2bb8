"""The index as a table: chunks with vectors, partitioned by class, subject and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import subject_slug

PARTITIONS = ("class", "subject_slug", "lang")


def save_index(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write chunks by class, subject and language; one subject's slug is made in one way here and on reading."""
    chunks.withColumn("subject_slug", subject_slug(F.col("subject"))).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def index_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("class", F.col("class").cast("string"))


def select_index(index: DataFrame, class_number: int | None = None, subject: str | None = None, lang: str = "en") -> DataFrame:
    """The rows of one class, subject and language. Without a subject the first slug in order; no row where there is none, never another's.

    Class 10 has one index for all subjects of a language, and a subject that ends with a language's name is taken as that index too.
    The predicates are on partition columns, so only those files are read.
    """
    out = index.where(F.col("lang") == lang)
    if class_number is not None:
        out = out.where(F.col("class") == str(class_number))
    if class_number == 10 or subject is not None and subject.startswith("all-subjects"):
        return out
    if subject is not None:
        slug = subject.lower().replace(" ", "-").replace("and", "").strip("-")
        bare = slug.removesuffix("-english").removesuffix("-hindi")
        return out.where(F.col("subject_slug").isin(slug, bare))
    first = out.agg(F.min("subject_slug").alias("first"))
    return out.join(F.broadcast(first), out["subject_slug"] == first["first"], "left_semi")


def index_path(class_number: Column, subject: Column, lang: Column) -> Column:
    """Where the index of a question or a chunk lies: class 10 has one for all subjects of a language."""
    name = F.when(lang == "hi", "hindi").when(lang == "en", "english").otherwise(lang)
    whole = F.concat(F.lit("all-subjects-"), name)
    return F.concat(F.lit("class-"), class_number.cast("string"), F.lit("/"), F.when(class_number.cast("string") == "10", whole).otherwise(F.concat(subject_slug(subject), F.lit("-"), lang)))


def asked_partitions(index: DataFrame, questions: DataFrame, most: int = 2000) -> DataFrame:
    """The rows of a stored index that some question (class, subject, lang) can meet, by predicates on the partition columns.

    The partitions asked for are no more than the catalogue has; beyond `most` of them all rows are returned, as pruning would gain little.
    """
    slug = F.when(F.col("class").cast("string") != "10", subject_slug(F.col("subject")))
    asked = questions.select(F.col("class").cast("string").alias("c"), slug.alias("s"), F.col("lang").alias("l")).distinct().limit(most + 1).collect()
    if len(asked) > most:
        return index
    wanted = F.lit(False)
    for c, lang in sorted({(r["c"], r["l"]) for r in asked if r["c"] is not None and r["l"] is not None}):
        mine = (F.col("class") == c) & (F.col("lang") == lang)
        slugs = sorted({r["s"] for r in asked if (r["c"], r["l"]) == (c, lang) and r["s"] is not None})
        wanted = wanted | (mine if c == "10" else mine & F.col("subject_slug").isin(slugs))
    return index.where(wanted)
