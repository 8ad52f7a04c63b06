"""Queries of the ingest side: extraction, gap filling, citation keys, discovery, code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.citekeys import STOP, resolve_keys
from lodestone.operators.lexical import bm25
from lodestone.operators.parsing import extracted_pairs
from lodestone.operators.similarity import fuzzy_title_join, greedy_keep
from lodestone.plans.base import N, P, half_up_sql, nuggets, papers
from lodestone.plans.retrieval import _bm25_sql, qa
from lodestone.plans.tools import SQL as TOOL_SQL
from lodestone.plans.tools import bibtex_keys
from lodestone.session import cut, half_up, key_of, read_table

CODE = ("implementation", "config", "experiment")


def nugget_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs recovered from fenced, broken-off model answers written from the nuggets."""
    n = nuggets(spark, folder, "question", "answer", "type", "thesis_relevance").where("question IS NOT NULL AND answer IS NOT NULL")
    one = F.to_json(F.struct("question", "answer", F.coalesce("type", F.lit("background")).alias("type"), F.col("thesis_relevance").alias("relevance")))
    raw = F.concat(F.lit("Here it is:\n```json\n["), one, F.lit(', {"question": "cut of'))
    e = extracted_pairs(n.select("nugget_id", raw.alias("raw")), "nugget_id", "raw")
    return e.groupBy("type", "relevance", "overall").agg(F.count(F.lit(1)).alias("pairs"))


def gapfill_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks worth another look: 100 words or more, no references, at most 2 nuggets."""
    skip = F.coalesce(F.lower(F.trim("section")), F.lit("")).isin("references", "acknowledgments", "bibliography")
    c = read_table(spark, folder, "chunks").where("text IS NOT NULL").select(key_of("paper_id").alias("paper_key"), "chunk_id", "text", "section").distinct()
    words = T.whitespace_words(F.col("text"))
    c = c.where((words >= 100) & ~skip & ~T.looks_like_references(F.col("text"))).select("paper_key", "chunk_id").distinct()
    n = nuggets(spark, folder, "paper_id", "section", "source_chunk").groupBy(key_of("paper_id").alias("paper_key"), F.col("source_chunk").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"))
    j = c.join(n, ["paper_key", "chunk_id"], "left").select("paper_key", "chunk_id", F.coalesce("n", F.lit(0)).alias("nuggets"))
    return j.where("nuggets <= 2")


def resolve_cite_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Where the citation keys of all papers lead."""
    keys = bibtex_keys(spark, folder)
    r = resolve_keys(keys, papers(spark, folder, "authors", "year").select("paper_key", "authors", "year", "title"))
    j = keys.join(r.withColumnRenamed("paper_key", "resolved"), "cite_key", "left")
    return j.select("paper_key", "cite_key", "resolved", half_up(F.coalesce("score", F.lit(0.0))).alias("score"))


def seed_papers(spark: SparkSession, folder: str) -> DataFrame:
    """The 30 most cited papers with an identifier: the seeds of a discovery."""
    p = papers(spark, folder, "arxiv_id", "doi", "citation_count").where("coalesce(trim(arxiv_id), trim(doi), '') <> ''")
    p = p.select("paper_key", F.coalesce("citation_count", F.lit(0)).alias("citations"))
    return p.orderBy(F.col("citations").desc(), "paper_key").limit(30)


def discovery_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Discovered candidates against the knowledge base: known by identifier, known by title,
    repeated among themselves (identifier or title of an earlier one that stays), or new.
    Candidates come in the order of their time and id."""
    blank = lambda c: F.nullif(c, F.lit(""))
    p = read_table(spark, folder, "papers").select(
        "paper_id", "added_at", "source", T.normal_title(F.coalesce("title", F.lit(""))).alias("norm"),
        blank(F.trim("arxiv_id")).alias("arxiv"), blank(F.lower(F.trim("doi"))).alias("doi"),
    )
    found = p.where("source = 'discovered'")
    kb = p.where("source IS NULL OR source <> 'discovered'")
    # Rows with the same title and identifiers fare alike, but that only the first may stay.
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    first = F.min(F.concat_ws("|", text("added_at"), text("paper_id"))).alias("first")
    c = found.groupBy("norm", "arxiv", "doi").agg(first, F.count(F.lit(1)).alias("n"))
    c = cut(c.withColumn("id", F.concat_ws("|", "first", "norm", text("arxiv"), text("doi"))).withColumn("key", F.coalesce("arxiv", "doi")))
    known = lambda col: kb.where(F.col(col).isNotNull()).select(col, F.lit(True).alias(f"known_{col}")).distinct()
    norms = lambda d: d.where("norm <> ''").select(F.col("norm").alias("id"), F.col("norm").alias("title")).distinct()

    def alike(left: DataFrame, right: DataFrame) -> DataFrame:
        same = left.select(F.col("id").alias("id_a")).join(right.select(F.col("id").alias("id_b")), F.col("id_a") == F.col("id_b"))
        return fuzzy_title_join(left, right).select("id_a", "id_b").unionByName(same).distinct()

    similar = alike(norms(c), norms(kb)).select(F.col("id_a").alias("norm"), F.lit(True).alias("known_title")).distinct()
    j = c.join(known("arxiv"), "arxiv", "left").join(known("doi"), "doi", "left").join(similar, "norm", "left")
    j = cut(j.withColumn("known_id", F.coalesce("known_arxiv", "known_doi")).where("norm <> '' OR known_id"))
    rest = j.where("known_id IS NULL AND known_title IS NULL")
    a, b = (rest.select(F.col("id").alias(f"id_{x}"), F.col("key").alias(f"key_{x}"), F.col("norm").alias(f"norm_{x}")) for x in "ab")
    titles = alike(norms(rest), norms(rest)).select(F.col("id_a").alias("norm_b"), F.col("id_b").alias("norm_a"))
    twins = a.join(titles, "norm_a").join(b, "norm_b").select("id_a", "id_b")
    twins = twins.unionByName(a.join(b, F.col("key_a") == F.col("key_b")).select("id_a", "id_b")).where("id_a < id_b")
    j = j.join(greedy_keep(twins).select("id", F.lit(True).alias("twin")), "id", "left")
    reason = F.when(F.col("known_id"), "exact_id").when(F.col("known_title"), "fuzzy_title").when(F.col("twin"), "cross_source").otherwise("kept")
    j = j.withColumn("reason", reason)
    parts = F.when(F.col("reason") == "kept", F.array(F.struct(F.lit("kept").alias("r"), F.lit(1).cast("long").alias("k")), F.struct(F.lit("cross_source").alias("r"), (F.col("n") - 1).alias("k"))))
    rows = j.select(F.explode(parts.otherwise(F.array(F.struct(F.col("reason").alias("r"), F.col("n").alias("k"))))).alias("p")).where("p.k > 0")
    return rows.groupBy(F.col("p.r").alias("reason")).agg(F.sum("p.k").alias("candidates"))


def code_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best 20 nuggets about code for a query, with the files linked to their papers."""
    n = nuggets(spark, folder, "paper_id", "type", "question", "answer").where(F.lower("type").isin(*CODE))
    q = spark.range(1).select(F.col("id").alias("query_id"), F.lit("frame rate").alias("query"))
    hits = bm25(q, n, 20, query_id="query_id", query="query", text_id="nugget_id", text=qa())
    links = read_table(spark, folder, "code_links").groupBy(key_of("paper_id").alias("paper_key")).agg(F.countDistinct("source_file").alias("files"))
    of = n.select(F.col("nugget_id").alias("id"), key_of("paper_id").alias("paper_key"), F.lower("type").alias("type"))
    return hits.join(of, "id").join(links, "paper_key", "left").select(F.col("id").alias("nugget_id"), "type", half_up(F.col("score")).alias("score"), F.coalesce("files", F.lit(0)).alias("files"))


def resume_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with chunks that have no nugget from a first load of methods yet (a resumed run
    over that kind), the oldest 50 first; papers of an id list alone (here: written with dots
    or underscores after four digits) are taken."""
    done = nuggets(spark, folder, "paper_id", "type").where("lower(type) = 'method' AND ingested_at < TIMESTAMP_NTZ '2024-01-10'").select(key_of("paper_id").alias("paper_key")).where("paper_key IS NOT NULL").distinct()
    chunked = read_table(spark, folder, "chunks").select(key_of("paper_id").alias("paper_key")).distinct()
    listed = papers(spark, folder).where(F.col("paper_key").rlike(r"^\d{4}[._]")).select("paper_key")
    p = papers(spark, folder).join(listed, "paper_key", "left_semi").join(chunked, "paper_key", "left_semi").join(done, "paper_key", "left_anti")
    return p.orderBy("added_at", "paper_key").limit(50).select("paper_key", F.date_format("added_at", "yyyy-MM-dd").alias("added"))


_PK = "CASE WHEN trim(paper_id) <> '' THEN lower(trim(paper_id)) END"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"

SQL = {
    "nugget_extraction": f"""WITH {N}, q AS (SELECT coalesce(type, 'background') AS type,
  CAST(CASE WHEN thesis_relevance IS NULL THEN 3 ELSE least(greatest(thesis_relevance, 1), 5) END AS INTEGER) AS relevance FROM n
  WHERE length(trim(question, ' ' || chr(9) || chr(10) || chr(13))) >= 10 AND length(trim(answer, ' ' || chr(9) || chr(10) || chr(13))) >= 10)
SELECT type, relevance, least(relevance, 3) AS overall, count(*) AS pairs FROM q GROUP BY ALL""",
    "gapfill_chunks": f"""WITH {N}, c AS (SELECT DISTINCT {_PK} AS paper_key, chunk_id, text, section FROM chunks WHERE text IS NOT NULL),
m AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS w, len(regexp_extract_all(text, '\\[\\d+\\]|\\(\\d{{4}}\\)|et al\\.|pp\\.|vol\\.|doi:|arXiv:')) AS k,
  len(regexp_extract_all(text, '(?m)^\\s*\\[\\d+\\]')) AS e FROM c),
g AS (SELECT DISTINCT paper_key, chunk_id FROM m WHERE w >= 100 AND NOT (w >= 20 AND (k / w::DOUBLE > 0.02 AND k >= 3 OR e >= 3))
  AND coalesce(lower(trim(section)), '') NOT IN ('references', 'acknowledgments', 'bibliography')),
x AS (SELECT {_PK} AS paper_key, source_chunk AS chunk_id, count(*) AS n FROM n GROUP BY 1, 2)
SELECT g.paper_key, g.chunk_id, coalesce(x.n, 0) AS nuggets FROM g LEFT JOIN x ON x.paper_key = g.paper_key AND x.chunk_id = g.chunk_id WHERE coalesce(x.n, 0) <= 2""",
    "seed_papers": f"""WITH {P} SELECT paper_key, coalesce(citation_count, 0) AS citations FROM p WHERE coalesce(trim(arxiv_id), trim(doi), '') <> ''
ORDER BY 2 DESC, 1 LIMIT 30""",
    "code_search": f"""WITH {N}, x AS (SELECT * FROM n WHERE lower(type) IN ('implementation', 'config', 'experiment')),
{_bm25_sql("SELECT 0 AS query_id, 'frame rate' AS query", "x", "nugget_id", 20, "and")},
l AS (SELECT {_PK} AS paper_key, count(DISTINCT source_file) AS files FROM code_links GROUP BY 1)
SELECT x.nugget_id, lower(x.type) AS type, {half_up_sql('score')} AS score, coalesce(files, 0) AS files
FROM bm JOIN x ON x.nugget_id = bm.id LEFT JOIN l ON l.paper_key = lower(trim(x.paper_id))""",
    "resume_filter": f"""WITH {N}, {P} SELECT paper_key, strftime(added_at, '%Y-%m-%d') AS added FROM p
WHERE paper_key IN (SELECT lower(trim(paper_id)) FROM chunks WHERE paper_id IS NOT NULL)
  AND regexp_matches(paper_key, '^\\d{{4}}[._]')
  AND paper_key NOT IN (SELECT lower(trim(paper_id)) FROM n WHERE trim(paper_id) <> '' AND lower(type) = 'method' AND ingested_at < TIMESTAMP '2024-01-10') ORDER BY added_at, paper_key LIMIT 50""",
    "resolve_cite_keys": "WITH bk AS (" + TOOL_SQL["bibtex_keys"] + f"), {P}" + f""", w AS (
  SELECT paper_key, year, list_filter(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')), lambda x: NOT list_contains({_STOP}, x)) AS tw,
    list_distinct(regexp_extract_all(lower(coalesce(authors, '')), '\\p{{L}}+')) AS names FROM p
), k AS (
  SELECT DISTINCT cite_key, lower(split_part(split_part(cite_key, ':', 1), '_', 1)) AS author,
    TRY_CAST(regexp_extract(split_part(cite_key, ':', 1), '(?:^|_)(\\d{{4}})(?:_|$)', 1) AS INTEGER) AS ky,
    list_distinct(regexp_extract_all(lower(regexp_replace(cite_key, '^[^:]*:', '')), '[a-z0-9]+')) AS slug FROM bk
), c AS (
  SELECT cite_key, paper_key, CASE WHEN ky IS NULL OR year = ky THEN 1 ELSE 2 END AS how, slug, tw FROM k JOIN w ON list_contains(names, author)
  UNION ALL
  SELECT cite_key, paper_key, 3, slug, tw FROM (SELECT *, list_filter(slug, lambda x: length(x) > 2)[1:3] AS f FROM k) JOIN w ON len(f) > 0 AND list_has_all(tw, f)
), s AS (
  SELECT cite_key, paper_key, how, CASE WHEN len(slug) > 0 THEN len(list_intersect(slug, tw)) / len(slug)::DOUBLE ELSE 0 END * 0.7
    + CASE WHEN len(tw) > 0 THEN len(list_intersect(slug, tw)) / len(tw)::DOUBLE ELSE 0 END * 0.3 AS score FROM c
), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY cite_key, how ORDER BY score DESC, paper_key) = 1),
r AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY cite_key ORDER BY CASE WHEN score >= 0.8 THEN 10 - how ELSE 0 END DESC, score DESC, how, paper_key DESC) = 1)
SELECT bk.paper_key, bk.cite_key, r.paper_key AS resolved, {half_up_sql('coalesce(r.score, 0)')} AS score FROM bk LEFT JOIN r ON r.cite_key = bk.cite_key""",
}

QUERIES = {
    f.__name__: f
    for f in (nugget_extraction, gapfill_chunks, resolve_cite_keys, seed_papers, discovery_dedup, code_search, resume_filter)
}
