"""Connected components of links between keys, by label propagation with pointer jumping; nothing of them comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(key, component): for every key of a link the least key it is linked to over any number of steps.

    Each round every key takes the least label among its neighbours', then its label's own label, until none changes; rounds grow
    with the logarithm of the longest chain. Each round's labels are a table in the shared folder, so that a lost executor costs no round.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = stored(edges.union(edges.select("y", "x")).distinct(), "links")
    labels = stored(edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).withColumnRenamed("x", "key"), "labels")
    while True:
        near = edges.join(labels, F.col("y") == F.col("key")).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("key") == F.col("x"), "left").select("key", F.least("label", "near").alias("next"), "label")
        jump = step.select(F.col("key").alias("k2"), F.col("next").alias("beyond"))
        done = step.join(jump, F.col("next") == F.col("k2"), "left").select("key", F.least("next", F.coalesce("beyond", "next")).alias("label"), F.col("label").alias("was"))
        done = stored(done, "labels")
        labels = done.select("key", "label")
        if done.where("label <> was").isEmpty():
            return labels.select("key", F.col("label").alias("component"))
