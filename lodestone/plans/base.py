"""What all plans share: the current state of the tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import key_of, read_table


def latest(df: DataFrame, key, *order) -> DataFrame:
    """One row per key: the greatest by the order columns. A max over structs, so rows shrink
    before the shuffle and no key's rows meet in one task. Rows with a null key are dropped."""
    rest = [c for c in df.columns if c not in order]
    packed = F.max(F.struct(*order, *rest)).alias("r")
    return df.withColumn("_key", key).where("_key IS NOT NULL").groupBy("_key").agg(packed).select("_key", "r.*").drop("_key")


def nuggets(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The last load of each nugget: its ids, its time and the given columns. Columns must be
    named, as the optimizer cannot prune the inside of the packed rows."""
    n = read_table(spark, folder, "nuggets").select("nugget_id", "ingested_at", "row_id", *columns)
    return latest(n, F.col("nugget_id"), "ingested_at", "row_id")


def papers(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The last metadata of each paper: paper_key, paper_id, title, added_at and the given columns."""
    p = read_table(spark, folder, "papers").select("paper_id", "title", "added_at", *columns)
    return latest(p, key_of("paper_id"), "added_at", "title", "paper_id").withColumn("paper_key", key_of("paper_id"))


N = (
    "n AS (SELECT * FROM nuggets WHERE nugget_id IS NOT NULL QUALIFY row_number() OVER "
    "(PARTITION BY nugget_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) = 1)"
)
P = (
    "p AS (SELECT *, lower(trim(paper_id)) AS paper_key FROM papers WHERE trim(paper_id) <> '' QUALIFY row_number() OVER "
    "(PARTITION BY lower(trim(paper_id)) ORDER BY added_at DESC NULLS LAST, title DESC NULLS LAST, paper_id DESC) = 1)"
)


def half_up_sql(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"
