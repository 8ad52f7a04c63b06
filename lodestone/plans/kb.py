"""Relational queries over the knowledge base: statistics, look-ups, feedback, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ranking import authority_boost
from lodestone.operators.references import iso_utc
from lodestone.plans.base import N, P, half_up_sql, nuggets, papers
from lodestone.session import half_up, key_of, read_table


def feedback_log(spark: SparkSession, folder: str) -> DataFrame:
    """nugget_key, query, rating, paper_key: the last rating of each (nugget, query). Blank
    queries and ratings outside -1..1 are no feedback; a rating without a time is the oldest."""
    f = read_table(spark, folder, "nugget_feedback").where("trim(query) <> '' AND rating BETWEEN -1 AND 1")
    at = F.coalesce(iso_utc("created_at"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    return (
        f.select(key_of("nugget_id").alias("nugget_key"), "query", at.alias("at"), "feedback_id", "rating", key_of("paper_id").alias("paper_key"))
        .where("nugget_key IS NOT NULL")
        .groupBy("nugget_key", "query")
        .agg(F.max(F.struct("at", "feedback_id", "rating", "paper_key")).alias("r"))
        .select("nugget_key", "query", "r.rating", "r.paper_key")
    )


def kb_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by type and by section in one pass over the nuggets."""
    n = nuggets(spark, folder, "type", "section").select(F.lower(F.coalesce("type", F.lit("(none)"))).alias("type"), F.coalesce("section", F.lit("(none)")).alias("section"))
    # Two grouping sets in one aggregation.
    return (
        n.cube("type", "section")
        .agg(F.count(F.lit(1)).alias("nuggets"), F.grouping_id().alias("g"))
        .where("g IN (1, 2)")
        .select(F.when(F.col("g") == 1, F.lit("type")).otherwise("section").alias("kind"), F.coalesce("type", "section").alias("value"), "nuggets")
    )


def papers_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return papers(spark, folder, "year").where("year IS NOT NULL").groupBy("year").agg(F.count(F.lit(1)).alias("papers"))


def paper_nugget_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Nuggets per known paper, also of papers without any."""
    c = nuggets(spark, folder, "paper_id").groupBy(key_of("paper_id").alias("paper_key")).agg(F.count(F.lit(1)).alias("nuggets"))
    return papers(spark, folder).join(c, "paper_key", "left").select("paper_key", "title", F.coalesce("nuggets", F.lit(0)).alias("nuggets"))


def find_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Papers whose authors and title match patterns, from a year on."""
    p = papers(spark, folder, "authors", "year")
    return p.where(F.col("authors").ilike("%el%") & F.col("title").ilike("%event%") & (F.col("year") >= 2015)).select("paper_key", "title", "year")


def token_search(spark: SparkSession, folder: str) -> DataFrame:
    """Papers where every token matches the title, the authors or the year."""
    hit = F.lit(True)
    for token in ("adaptive", "20"):
        t = f"%{token}%"
        hit = hit & (F.coalesce(F.col("title").ilike(t), F.lit(False)) | F.coalesce(F.col("authors").ilike(t), F.lit(False)) | F.coalesce(F.col("year").cast("string").ilike(t), F.lit(False)))
    return papers(spark, folder, "authors", "year").where(hit).select("paper_key", "title")


def paper_info(spark: SparkSession, folder: str) -> DataFrame:
    """Nuggets of each paper by type, with the paper's metadata."""
    n = nuggets(spark, folder, "paper_id", "type").select(key_of("paper_id").alias("paper_key"), F.lower("type").alias("type"))
    c = n.where("type IN ('method', 'result', 'claim')").groupBy("paper_key", "type").agg(F.count(F.lit(1)).alias("nuggets"))
    p = papers(spark, folder, "year", "citation_count").select("paper_key", F.col("year").cast("string").alias("year"), F.coalesce("citation_count", F.lit(0)).alias("citations"))
    return p.join(c, "paper_key")


def feedback_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Summed ratings of nuggets, where not zero."""
    f = feedback_log(spark, folder).groupBy("nugget_key").agg(F.sum("rating").cast("long").alias("total"))
    return f.where("total <> 0")


def paper_feedback(spark: SparkSession, folder: str) -> DataFrame:
    f = feedback_log(spark, folder).where("paper_key IS NOT NULL")
    return f.groupBy("paper_key").agg(F.sum("rating").cast("long").alias("total"), F.count(F.lit(1)).alias("votes"))


def exclude_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Nuggets per type without those of papers that anyone rated down."""
    bad = feedback_log(spark, folder).where("rating < 0 AND paper_key IS NOT NULL").select("paper_key").distinct()
    n = nuggets(spark, folder, "paper_id", "type").withColumn("paper_key", key_of("paper_id"))
    return n.join(bad, "paper_key", "left_anti").groupBy(F.lower("type").alias("type")).agg(F.count(F.lit(1)).alias("nuggets"))


def semi_search(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with a nugget that mentions background clutter."""
    hit = F.lower(F.concat_ws(" ", "question", "answer")).contains("background clutter")
    n = nuggets(spark, folder, "paper_id", "question", "answer").where(hit).select(key_of("paper_id").alias("paper_key"))
    return papers(spark, folder).join(n, "paper_key", "left_semi").select("paper_key", "title")


def left_links(spark: SparkSession, folder: str) -> DataFrame:
    """Code links with the titles of their papers."""
    c = read_table(spark, folder, "code_links").withColumn("paper_key", key_of("paper_id"))
    return c.join(papers(spark, folder).select("paper_key", "title"), "paper_key", "left").select("id", "source_file", F.lower("link_type").alias("link_type"), "title")


def find_implementations(spark: SparkSession, folder: str) -> DataFrame:
    """Implementing files per paper, repeated links once."""
    c = read_table(spark, folder, "code_links").select(key_of("paper_id").alias("paper_key"), "source_file", F.lower("link_type").alias("link_type"))
    c = c.where("paper_key IS NOT NULL AND link_type = 'implements'").distinct()
    return c.groupBy("paper_key").agg(F.array_join(F.array_sort(F.collect_set("source_file")), ";").alias("files"))


def find_papers_for_code(spark: SparkSession, folder: str) -> DataFrame:
    c = read_table(spark, folder, "code_links").where(F.col("source_file").ilike("%motion%")).select(key_of("paper_id").alias("paper_key"), "source_file").distinct()
    return c.join(papers(spark, folder, "year").select("paper_key", "title", F.col("year").cast("string").alias("year")), "paper_key").select("source_file", "paper_key", "title", "year")


def authority_score(spark: SparkSession, folder: str) -> DataFrame:
    """The authority boost of each paper in the mode ``background``."""
    boost = authority_boost(F.lit(True), F.col("year"), F.col("title"), F.col("citation_count"), F.col("influential_citation_count"), F.col("paper_type"), 1.5, 0.3)
    return papers(spark, folder, "year", "citation_count", "influential_citation_count", "paper_type").select("paper_key", half_up(boost).alias("boost"))


def paper_type_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Papers and mean citations by type."""
    kinds = F.explode(F.split(F.coalesce("paper_type", F.lit("")), ","))
    p = papers(spark, folder, "citation_count", "paper_type").select(kinds.alias("kind"), "citation_count")
    return p.groupBy(F.trim("kind").alias("kind")).agg(F.count(F.lit(1)).alias("papers"), half_up(F.avg("citation_count"), 3).alias("mean_citations"))


def depth_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of a phrase per paper, their share and the depth boost."""
    n = nuggets(spark, folder, "paper_id", "question", "answer").select(key_of("paper_id").alias("paper_key"), F.lower(F.concat_ws(" ", "question", "answer")).contains("frame rate").alias("hit"))
    g = n.where("paper_key IS NOT NULL").groupBy("paper_key").agg(F.count(F.when(F.col("hit"), True)).alias("hits"), F.count(F.lit(1)).alias("total"))
    boost = F.least(F.col("hits") / F.col("total"), F.lit(1.0)) * 0.3 + F.least(F.log2(F.col("hits").cast("double")) / 5.0, F.lit(0.3)) + 1
    return g.where("hits > 0").select("paper_key", "hits", "total", half_up(boost).alias("boost"))


def score_distribution(spark: SparkSession, folder: str) -> DataFrame:
    n = nuggets(spark, folder, "thesis_relevance", "flagged")
    return n.groupBy(F.coalesce("thesis_relevance", F.lit(0)).alias("relevance")).agg(F.count(F.lit(1)).alias("nuggets"), F.count(F.when(F.col("flagged") == 1, True)).alias("flagged"))


def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per paper: mean of the usable scores and how many are weak."""
    s = F.when(F.col("overall_score").between(1, 5) & ~F.isnan("overall_score"), F.col("overall_score"))
    g = nuggets(spark, folder, "paper_id", "overall_score").select(key_of("paper_id").alias("paper_key"), s.alias("s")).where("paper_key IS NOT NULL").groupBy("paper_key")
    return g.agg(half_up(F.avg("s"), 2).alias("mean_score"), F.count(F.when(F.col("s") <= 2, True)).alias("weak"), F.count(F.lit(1)).alias("nuggets"))


def missing_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Papers without a year, authors or a proper title."""
    p = papers(spark, folder, "authors", "year")
    no_authors = F.col("authors").isNull() | (F.trim("authors") == "") | (F.col("authors") == "[]")
    odd_title = F.col("title").isNull() | F.trim("title").rlike(r"^(\d{4}[\s_.]\d{4,5}(v\d+)?)?$")
    return p.where(F.col("year").isNull() | no_authors | odd_title).select("paper_key", F.col("year").isNull().alias("no_year"), no_authors.alias("no_authors"), odd_title.alias("odd_title"))


_FB = """fb AS (
  SELECT lower(trim(nugget_id)) AS nugget_key, query, arg_max(rating, (ts, feedback_id)) AS rating,
    arg_max(coalesce(lower(trim(paper_id)), ''), (ts, feedback_id)) AS pk
  FROM (SELECT *, coalesce(CASE WHEN regexp_matches(created_at, '(Z|[+-][0-9]{2}:[0-9]{2})$')
      THEN CAST(timezone('UTC', CAST(created_at AS TIMESTAMPTZ)) AS TIMESTAMP)
      ELSE TRY_CAST(created_at AS TIMESTAMP) END, TIMESTAMP '0001-01-01') AS ts FROM nugget_feedback
    WHERE trim(nugget_id) <> '' AND trim(query) <> '' AND rating BETWEEN -1 AND 1)
  GROUP BY 1, 2
), fbk AS (SELECT *, nullif(pk, '') AS paper_key FROM fb)"""
_PK = "CASE WHEN trim(paper_id) <> '' THEN lower(trim(paper_id)) END"
_AUTH = """CASE WHEN year IS NULL OR coalesce(title, '') = '' OR regexp_matches(title, '^\\d{4}[\\s_]\\d{4,5}$') THEN 0.3
  ELSE 1 + 1.5::DOUBLE * 0.1 * least(log10(greatest(coalesce(citation_count, 0), 1)), 4.0)
    + CASE WHEN influential_citation_count > 10 THEN 0.1 ELSE 0 END
    + CASE WHEN regexp_matches(lower(coalesce(paper_type, '')), 'review|survey') THEN 0.3 ELSE 0 END END"""

SQL = {
    "kb_stats": f"""WITH {N} SELECT 'type' AS kind, lower(coalesce(type, '(none)')) AS value, count(*) AS nuggets FROM n GROUP BY 2
UNION ALL SELECT 'section', coalesce(section, '(none)'), count(*) FROM n GROUP BY 2""",
    "papers_by_year": f"WITH {P} SELECT year, count(*) AS papers FROM p WHERE year IS NOT NULL GROUP BY 1",
    "paper_nugget_counts": f"""WITH {N}, {P}, c AS (SELECT {_PK} AS k, count(*) AS c FROM n GROUP BY 1)
SELECT paper_key, title, coalesce(c, 0) AS nuggets FROM p LEFT JOIN c ON c.k = p.paper_key""",
    "find_papers": f"WITH {P} SELECT paper_key, title, year FROM p WHERE authors ILIKE '%el%' AND title ILIKE '%event%' AND year >= 2015",
    "token_search": f"""WITH {P} SELECT paper_key, title FROM p
WHERE (coalesce(title ILIKE '%adaptive%', false) OR coalesce(authors ILIKE '%adaptive%', false) OR coalesce(CAST(year AS VARCHAR) ILIKE '%adaptive%', false))
  AND (coalesce(title ILIKE '%20%', false) OR coalesce(authors ILIKE '%20%', false) OR coalesce(CAST(year AS VARCHAR) ILIKE '%20%', false))""",
    "paper_info": f"""WITH {N}, {P}, c AS (SELECT {_PK} AS k, lower(type) AS type, count(*) AS nuggets FROM n
  WHERE lower(type) IN ('method', 'result', 'claim') GROUP BY 1, 2)
SELECT paper_key, CAST(year AS VARCHAR) AS year, coalesce(citation_count, 0) AS citations, type, nuggets FROM p JOIN c ON c.k = p.paper_key""",
    "feedback_sums": f"WITH {_FB} SELECT nugget_key, CAST(sum(rating) AS BIGINT) AS total FROM fbk GROUP BY 1 HAVING sum(rating) <> 0",
    "paper_feedback": f"WITH {_FB} SELECT paper_key, CAST(sum(rating) AS BIGINT) AS total, count(*) AS votes FROM fbk WHERE paper_key IS NOT NULL GROUP BY 1",
    "exclude_anti": f"""WITH {N}, {_FB} SELECT lower(type) AS type, count(*) AS nuggets FROM n
WHERE NOT EXISTS (SELECT 1 FROM fbk WHERE rating < 0 AND fbk.paper_key = {_PK.replace('paper_id', 'n.paper_id')}) GROUP BY 1""",
    "semi_search": f"""WITH {N}, {P} SELECT paper_key, title FROM p WHERE paper_key IN (
SELECT {_PK} FROM n WHERE contains(lower(concat_ws(' ', question, answer)), 'background clutter') AND paper_id IS NOT NULL)""",
    "left_links": f"WITH {P} SELECT c.id, c.source_file, lower(c.link_type) AS link_type, p.title FROM code_links c LEFT JOIN p ON p.paper_key = {_PK.replace('paper_id', 'c.paper_id')}",
    "find_implementations": f"""SELECT {_PK} AS paper_key, array_to_string(list_sort(list(DISTINCT source_file)), ';') AS files FROM code_links
WHERE lower(link_type) = 'implements' AND trim(paper_id) <> '' GROUP BY 1""",
    "find_papers_for_code": f"""WITH {P} SELECT DISTINCT c.source_file, p.paper_key, p.title, CAST(p.year AS VARCHAR) AS year FROM code_links c
JOIN p ON p.paper_key = {_PK.replace('paper_id', 'c.paper_id')} WHERE c.source_file ILIKE '%motion%'""",
    "authority_score": f"WITH {P} SELECT paper_key, {half_up_sql(_AUTH)} AS boost FROM p",
    "paper_type_stats": f"""WITH {P}, k AS (SELECT trim(unnest(string_split(coalesce(paper_type, ''), ','))) AS kind, citation_count FROM p)
SELECT kind, count(*) AS papers, {half_up_sql('avg(citation_count)', 3)} AS mean_citations FROM k GROUP BY 1""",
    "depth_coverage": f"""WITH {N}, g AS (SELECT {_PK} AS paper_key, count(*) FILTER (WHERE contains(lower(concat_ws(' ', question, answer)), 'frame rate')) AS hits,
  count(*) AS total FROM n WHERE trim(paper_id) <> '' GROUP BY 1)
SELECT paper_key, hits, total, {half_up_sql("least(hits / total::DOUBLE, 1.0) * 0.3 + least(log2(hits) / 5::DOUBLE, 0.3) + 1")} AS boost FROM g WHERE hits > 0""",
    "score_distribution": f"WITH {N} SELECT coalesce(thesis_relevance, 0) AS relevance, count(*) AS nuggets, count(*) FILTER (WHERE flagged = 1) AS flagged FROM n GROUP BY 1",
    "quality_summary": f"""WITH {N}, s AS (SELECT {_PK} AS paper_key, CASE WHEN overall_score BETWEEN 1 AND 5 AND NOT isnan(overall_score) THEN overall_score END AS s FROM n)
SELECT paper_key, {half_up_sql('avg(s)', 2)} AS mean_score, count(*) FILTER (WHERE s <= 2) AS weak, count(*) AS nuggets FROM s WHERE paper_key IS NOT NULL GROUP BY 1""",
    "missing_metadata": f"""WITH {P}, f AS (SELECT paper_key, year IS NULL AS no_year, authors IS NULL OR trim(authors) = '' OR authors = '[]' AS no_authors,
  title IS NULL OR regexp_matches(trim(title), '^(\\d{{4}}[\\s_.]\\d{{4,5}}(v\\d+)?)?$') AS odd_title FROM p)
SELECT * FROM f WHERE no_year OR no_authors OR odd_title""",
}

QUERIES = {
    f.__name__: f
    for f in (
        kb_stats, papers_by_year, paper_nugget_counts, find_papers, token_search, paper_info, feedback_sums, paper_feedback,
        exclude_anti, semi_search, left_links, find_implementations, find_papers_for_code, authority_score, paper_type_stats,
        depth_coverage, score_distribution, quality_summary, missing_metadata,
    )
}
