"""Summaries of runs: outcomes, modes, response times, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def status_counts(results: DataFrame, status: str = "status") -> DataFrame:
    """(status, n, percent): outcomes and their share of all."""
    counted = results.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 4))


def mode_distribution(results: DataFrame, mode: str, status: str = "status") -> DataFrame:
    """(mode, n) over successes."""
    return results.where(F.col(status) == "success").groupBy(F.col(mode).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def outcomes(calls: DataFrame, outcome: str) -> DataFrame:
    """(outcome, n): calls by how they ended."""
    return calls.groupBy(F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def cases_of_class(cases: DataFrame, class_number: int, klass: str = "class") -> DataFrame:
    """The test cases of one class."""
    return cases.where(F.col(klass) == class_number)


def subject_outcomes(processed: DataFrame, subject: str, succeeded: Column) -> DataFrame:
    """(subject, succeeded, failed, outcome): what became of each subject; one failure makes it FAILED."""
    out = processed.groupBy(F.col(subject).alias("subject")).agg(F.count_if(succeeded).alias("succeeded"), F.count_if(~succeeded).alias("failed"))
    return out.withColumn("outcome", F.when(F.col("failed") == 0, "SUCCESS").otherwise("FAILED"))


def seconds_between(start: str, end: str) -> Column:
    """Seconds from one time to another, NULL where one is missing."""
    return (F.unix_micros(F.col(end)) - F.unix_micros(F.col(start))) / 1e6


def latency(results: DataFrame, seconds: str, by: str | None = None) -> DataFrame:
    """(by, n, avg_s, min_s, max_s)."""
    grouped = results.groupBy(by) if by else results.groupBy()
    return grouped.agg(F.count(seconds).alias("n"), F.round(F.avg(seconds), 6).alias("avg_s"), F.min(seconds).alias("min_s"), F.max(seconds).alias("max_s"))


def class_pivot(results: DataFrame, klass: str, status: str = "status") -> DataFrame:
    """(class, success, rejected, error, total, success_percent), rows without a class left out."""
    count = lambda s: F.count(F.when(F.col(status) == s, 1)).alias(s)
    out = results.where(F.col(klass).isNotNull()).groupBy(F.col(klass).alias("class")).agg(count("success"), count("rejected"), count("error"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("success_percent", F.when(F.col("total") > 0, F.round(F.col("success") * 100.0 / F.col("total"), 4)).otherwise(0.0))


def passed_of(results: DataFrame, flag: str) -> DataFrame:
    """(passed, total) over rows whose flag is set either way."""
    return results.agg(F.count_if(F.col(flag)).alias("passed"), F.count(flag).alias("total"))


def unique_citations(citations: DataFrame, by: str, order: str) -> DataFrame:
    """The first citation of each class, subject, chapter and page, numbered from 1 within `by`."""
    key = [F.coalesce(F.col(c), F.lit("")) for c in ("class", "subject", "chapter", "page")]
    nth = F.row_number().over(W.partitionBy(by, *key).orderBy(order))
    first = citations.withColumn("_n", nth).where("_n = 1").drop("_n")
    return first.withColumn("number", F.row_number().over(W.partitionBy(by).orderBy(order)))
