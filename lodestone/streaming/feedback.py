"""Feedback and events as streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.references import iso_utc
from lodestone.session import ensure_checkpoint_dir, key_of, read_table


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"stream-{uuid.uuid4().hex}")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    batch = read_table(spark, folder, name)
    path = os.path.join(folder, f"{name}.parquet")
    reader = spark.readStream.schema(batch.schema)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


#: Parts that a kept table is divided into by key.
PARTS = 16


def counts_by_day(events: DataFrame) -> DataFrame:
    """day, event_type, events: tumbling windows of a day over a stream with ts, event_type.
    There is no watermark: an event counts however late it comes. The state is one number per
    day and type, which stays small."""
    g = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "events")


def event_counts(spark: SparkSession, folder: str, target: str | None = None, stream: DataFrame | None = None) -> DataFrame:
    """Events per type and day. In update mode each micro-batch puts out the windows it
    changed; the greatest count of a window, which only grows, is its last. With a ``target``
    folder a later call goes on where the earlier one ended."""
    stream = table_stream(spark, folder, "events") if stream is None else stream
    flat = counts_by_day(stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type"))
    target = target or _folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/out/batch={number}")

    flat.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(flat.schema).parquet(f"{target}/out")
    return out.groupBy("day", "event_type").agg(F.max("events").alias("events"))


def _versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """The path of the last whole version of each part, of versions below ``before`` if given.
    What is on disk is all there is to know, so a restart goes on from it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(f"{target}/data")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    number = lambda path: int(path.getName().split("=")[1])
    whole = {number(f.getPath().getParent()) for f in files.globStatus(hadoop(f"{target}/data/v=*/_SUCCESS")) or []}
    out: dict[int, tuple[int, str]] = {}
    for status in files.globStatus(hadoop(f"{target}/data/v=*/part=*")) or []:
        part, version = number(status.getPath()), number(status.getPath().getParent())
        if version in whole and (before is None or version < before) and version >= out.get(part, (-1, ""))[0]:
            out[part] = version, status.getPath().toString()
    return {part: path for part, (_, path) in out.items()}


def keep_last(spark: SparkSession, rows: DataFrame, target: str) -> None:
    """Keeps the last rating of each nugget and query of a stream (nugget_key, query, at,
    feedback_id, rating) below ``target``. The table lies in PARTS parts by key; a micro-batch
    writes a new version of the parts that it touches, in one job, and a batch that is repeated
    after a failure overwrites its own attempt."""
    last = F.max(F.struct("at", "feedback_id", "rating")).alias("r")

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        mine = batch.withColumn("part", F.pmod(F.xxhash64("nugget_key", "query"), F.lit(PARTS)).cast("int")).persist()
        try:
            touched = {r["part"] for r in mine.select("part").distinct().collect()}
            old = [path for part, path in _versions(s, target, number).items() if part in touched]
            both = mine
            if old:
                both = mine.unionByName(s.read.option("basePath", f"{target}/data").schema(f"{batch._jdf.schema().toDDL()}, part int, v long").parquet(*old).drop("v"))
            merged = both.groupBy("part", "nugget_key", "query").agg(last).select("part", "nugget_key", "query", "r.*")
            merged.write.mode("overwrite").partitionBy("part").parquet(f"{target}/data/v={number}")
        finally:
            mine.unpersist()

    rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()


def feedback_latest(spark: SparkSession, folder: str, target: str | None = None, stream: DataFrame | None = None) -> DataFrame:
    """The last rating of each nugget and query, kept up by micro-batches. With a ``target``
    folder a later call goes on where the earlier one ended."""
    target = target or _folder(spark)
    stream = table_stream(spark, folder, "nugget_feedback") if stream is None else stream
    at = F.coalesce(iso_utc("created_at"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    rows = stream.where("trim(query) <> '' AND rating BETWEEN -1 AND 1").select(
        key_of("nugget_id").alias("nugget_key"), "query", at.alias("at"), "feedback_id", "rating"
    ).where("nugget_key IS NOT NULL")
    keep_last(spark, rows, target)
    paths = list(_versions(spark, target).values())
    if not paths:
        return spark.createDataFrame([], "nugget_key string, query string, rating int")
    return spark.read.parquet(*paths).select("nugget_key", "query", "rating")


SQL = {
    "streaming_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "streaming_feedback": """SELECT lower(trim(nugget_id)) AS nugget_key, query, arg_max(rating, (ts, feedback_id)) AS rating
FROM (SELECT *, coalesce(CASE WHEN regexp_matches(created_at, '(Z|[+-][0-9]{2}:[0-9]{2})$')
    THEN CAST(timezone('UTC', CAST(created_at AS TIMESTAMPTZ)) AS TIMESTAMP)
    ELSE TRY_CAST(created_at AS TIMESTAMP) END, TIMESTAMP '0001-01-01') AS ts FROM nugget_feedback
  WHERE trim(nugget_id) <> '' AND trim(query) <> '' AND rating BETWEEN -1 AND 1)
GROUP BY 1, 2""",
}
QUERIES = {"streaming_feedback": feedback_latest, "streaming_counts": event_counts}
