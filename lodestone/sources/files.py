"""JSON, JSON lines, CSV, Atom feeds, file names and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUGGET_SCHEMA = (
    "nugget_id string, paper_id string, question string, answer string, type string, section string, pages array<int>, "
    "source_chunk string, origin string, quality struct<relevance:int,specificity:int,self_contained:int,type_accuracy:int,"
    "coherence:int,thesis_relevance:int,overall:int,flags:array<string>>, _removed boolean"
)
MANIFEST_SCHEMA = (
    "paper_id string, local_pdf string, title string, authors array<string>, year int, arxiv_id string, doi string, abstract string, "
    "source string, citation_count bigint, influential_citation_count bigint, publication_types array<string>"
)


def read_json(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """A file with one JSON array or object."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = NUGGET_SCHEMA, removed: bool = False) -> DataFrame:
    """JSON lines, blank lines skipped; removed records only where asked for."""
    df = spark.read.schema(schema).json(path)
    if "_removed" in df.columns and not removed:
        df = df.where(~F.coalesce("_removed", F.lit(False)))
    return df


def write_jsonl(df: DataFrame, path: str, removed: DataFrame | None = None) -> None:
    """JSON lines; removed records follow, marked ``_removed``."""
    if removed is not None:
        df = df.unionByName(removed.withColumn("_removed", F.lit(True)), allowMissingColumns=True)
    df.write.mode("overwrite").json(path)


def jsonl_count(spark: SparkSession, path: str) -> int:
    """The number of lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    schema = "title string, authors string, year string, venue string, occurrence_count int, source_pdfs string"
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_citations(raw: DataFrame, path: str) -> None:
    """Raw citations joined by normalised title: first non-empty fields, count and sources."""
    first = lambda c: F.first(F.when(F.trim(c) != "", F.col(c)), ignorenulls=True).alias(c)
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    out = (
        raw.groupBy(key.alias("k"))
        .agg(first("title"), first("authors"), first("year"), first("venue"), F.count(F.lit(1)).alias("occurrence_count"),
             F.array_join(F.array_sort(F.collect_set("source_pdf")), ";").alias("source_pdfs"))
        .where("k <> ''")
        .drop("k")
    )
    out.write.mode("overwrite").csv(path, header=True, escape='"')


def read_reference_export(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited id|arxiv|title|year; lines with fewer fields are dropped, a year that is
    no number is null."""
    p = F.split("value", r"\|")
    rows = spark.read.text(path).where(F.size(p) >= 4)
    part = lambda i: F.nullif(F.trim(F.get(p, F.lit(i))), F.lit(""))
    return rows.select(part(0).alias("item_id"), part(1).alias("arxiv_id"), part(2).alias("title"), part(3).try_cast("int").alias("year"))


def read_pdf_names(spark: SparkSession, folder: str) -> DataFrame:
    """path, authors, year, title from names such as "Authors - 2020 - Title.pdf"; names of
    another form are the title."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path")
    stem = F.regexp_replace(F.regexp_extract(F.url_decode("path"), r"([^/]+)$", 1), r"(?i)\.pdf$", "")
    three = F.regexp_extract(stem, r"^(.+?)\s+-\s+(\d{4})\s+-\s+(.+)$", 0) != ""
    two = F.regexp_extract(stem, r"^(.+?)\s+-\s+(.+)$", 0) != ""
    g = lambda k: F.regexp_extract(stem, r"^(.+?)\s+-\s+(\d{4})\s+-\s+(.+)$", k)
    h = lambda k: F.regexp_extract(stem, r"^(.+?)\s+-\s+(.+)$", k)
    return files.select(
        "path",
        F.when(three, g(1)).when(two, h(1)).alias("authors"),
        F.when(three, g(2).try_cast("int")).alias("year"),
        F.when(three, g(3)).when(two, h(2)).otherwise(stem).alias("title"),
    ).orderBy("path")


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """arxiv_id, title, authors, published, abstract of the entries of Atom feeds."""
    feed = spark.read.text(path, wholetext=True)
    entries = feed.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<entry>.*?</entry>"), 0)).alias("e"))
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    x = lambda path_: F.xpath_string("e", F.lit(path_))
    return entries.select(
        F.regexp_extract(x("entry/id"), r"abs/(.+?)(?:v\d+)?$", 1).alias("arxiv_id"),
        tidy(x("entry/title")).alias("title"),
        F.xpath("e", F.lit("entry/author/name/text()")).alias("authors"),
        F.to_date(F.substring(x("entry/published"), 1, 10)).alias("published"),
        tidy(x("entry/summary")).alias("abstract"),
    )


TRACE_SCHEMA = T.StructType().add("ts", "string").add("query", "string").add("mode", "string").add("elapsed_s", "double").add(
    "top_nuggets", T.ArrayType(T.StructType().add("nugget_id", "string").add("score", "double"))
)


def append_trace(traces: DataFrame, path: str) -> None:
    """Append retrieval traces, at most 30 nuggets each."""
    traces.withColumn("top_nuggets", F.slice("top_nuggets", 1, 30)).write.mode("append").json(path)
