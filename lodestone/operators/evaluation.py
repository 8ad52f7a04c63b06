"""Retrieval judged against expected items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected_recall(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """query_id, expected, found, recall, passed: how many of the items expected of each query
    were retrieved; a query passes with all of them. Both sides have query_id, item; repeated
    rows count once, nulls not at all, and queries without an expected item have no row."""
    e = expected.select("query_id", "item").where("query_id IS NOT NULL AND item IS NOT NULL").distinct()
    r = retrieved.select("query_id", "item").where("item IS NOT NULL").distinct().withColumn("hit", F.lit(1))
    g = e.join(r, ["query_id", "item"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found"))
    return g.select("query_id", "expected", "found", (F.col("found") / F.col("expected")).alias("recall"), (F.col("found") == F.col("expected")).alias("passed"))


def missing_items(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """query_id, item: what was expected and not retrieved."""
    e = expected.select("query_id", "item").where("query_id IS NOT NULL AND item IS NOT NULL").distinct()
    return e.join(retrieved.select("query_id", "item").distinct(), ["query_id", "item"], "left_anti")
