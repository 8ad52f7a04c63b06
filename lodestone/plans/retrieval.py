"""Retrieval queries: vectors, words, fusion, boosts, reranking, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.config import Retrieval
from lodestone.functions.text import TITLE_STOPWORDS
from lodestone.operators import ranking as R
from lodestone.operators.lexical import bm25
from lodestone.operators.vectors import cosine_similarity, nearest
from lodestone.plans.base import N, P, half_up_sql, nuggets, papers
from lodestone.session import half_up, key_of, read_table

#: The length of each ranked list before fusion.
N_RETRIEVE = Retrieval().n_retrieve


def qa() -> Column:
    """Question and answer as one text."""
    return F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select("vec_id", "embedding")


def _nugget_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of nuggets that have a vector (row_id is the vector's id)."""
    return read_table(spark, folder, "nuggets").join(_vectors(spark, folder), F.col("row_id") == F.col("vec_id"))


def _enriched(hits: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    n = read_table(spark, folder, "nuggets").select("row_id", "nugget_id", "type", "section", key_of("paper_id").alias("paper_key"))
    p = papers(spark, folder, "year").select("paper_key", "title", "year")
    return (
        hits.join(n, hits["vec_id"] == n["row_id"])
        .join(p, "paper_key", "left")
        .select("nugget_id", "type", "section", "title", F.col("year").cast("string").alias("year"), half_up(F.col("distance")).alias("distance"))
    )


def vector_topk_enriched(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest method and result nuggets to vector 1, with their papers."""
    v = _nugget_vectors(spark, folder).where(F.lower("type").isin("method", "result")).select("vec_id", "embedding")
    q = _vectors(spark, folder).where("vec_id = 1").withColumnRenamed("vec_id", "query_id")
    return _enriched(nearest(q, v, 20), spark, folder)


def vector_year_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The 15 nearest nuggets of papers from 2016 to 2020; the years are filtered first."""
    p = papers(spark, folder, "year").where("year BETWEEN 2016 AND 2020").select("paper_key")
    v = _nugget_vectors(spark, folder).withColumn("paper_key", key_of("paper_id")).join(p, "paper_key", "left_semi")
    q = _vectors(spark, folder).where("vec_id = 3").withColumnRenamed("vec_id", "query_id")
    return _enriched(nearest(q, v.select("vec_id", "embedding"), 15), spark, folder)


def vector_multi_query(spark: SparkSession, folder: str) -> DataFrame:
    """Three query vectors, 9 nearest each, the nearest sighting of each vector, best 18."""
    v = _vectors(spark, folder)
    q = v.where("vec_id IN (5, 50, 100)").withColumnRenamed("vec_id", "query_id")
    best = nearest(q, v, 9).groupBy("vec_id").agg(F.min("distance").alias("d"))
    return best.orderBy("d", "vec_id").limit(18).select("vec_id", half_up(F.col("d")).alias("distance"))


def knn_self_join(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest vectors of every 50th vector."""
    v = _vectors(spark, folder)
    q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return nearest(q, v, 10, exclude_self=True).select("query_id", "vec_id", half_up(F.col("distance")).alias("distance"), "rank")


def _feedback_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every 50th logged query that is not blank."""
    f = read_table(spark, folder, "nugget_feedback").where("feedback_id % 50 = 0 AND trim(query) <> ''")
    return f.select(F.col("feedback_id").alias("query_id"), "query")


def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best 50 nuggets with all the words of one query."""
    q = spark.range(1).select(F.col("id").alias("query_id"), F.lit("sparse sensor calibration").alias("query"))
    return bm25(q, nuggets(spark, folder, "question", "answer"), 50, query_id="query_id", query="query", text_id="nugget_id", text=qa()).select(
        F.col("id").alias("nugget_id"), half_up(F.col("score")).alias("score"), "rank"
    )


def bm25_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The best 10 nuggets for every 50th logged query, hyphenated words as phrases."""
    q = _feedback_queries(spark, folder)
    return bm25(q, nuggets(spark, folder, "question", "answer"), 10, query_id="query_id", query="query", text_id="nugget_id", text=qa()).select(
        "query_id", F.col("id").alias("nugget_id"), half_up(F.col("score")).alias("score"), "rank"
    )


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    """For every 50th vector with a nugget: its vector list and the BM25 list of its question."""
    n = read_table(spark, folder, "nuggets").select("row_id", "question", "answer")
    v = _vectors(spark, folder)
    q = v.where("vec_id % 50 = 0 AND vec_id > 0").withColumnRenamed("vec_id", "query_id")
    vector = nearest(q, v, N_RETRIEVE).select("query_id", F.col("vec_id").alias("id"), F.lit("vector").alias("list"), "rank", F.lit(1.0).alias("weight"))
    text_q = n.join(q, n["row_id"] == q["query_id"]).select("query_id", F.col("question").alias("query"))
    hits = bm25(text_q, n, N_RETRIEVE, query_id="query_id", query="query", text_id="row_id", text=qa(), mode="or")
    lexical = R.merged_lexical(hits).select("query_id", "id", F.lit("bm25").alias("list"), "rank", F.lit(1.0).alias("weight"))
    return vector.unionByName(lexical)


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Fused scores of the vector and word lists of every 50th vector."""
    f = R.fuse(_lists(spark, folder))
    return f.select("query_id", F.col("id").alias("row_id"), half_up(F.col("rrf"), 6).alias("rrf"), "overlap")


#: Weight of the list that a hypothetical passage finds.
PASSAGE_WEIGHT = 1.0


def passage_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Fused lists with one more: that of a hypothetical answer, found by vector alone and
    without a type. The passage's vector is that of the following nugget, as no model answers."""
    v = _vectors(spark, folder)
    asked = v.where("vec_id % 50 = 0 AND vec_id > 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("next"))
    q = v.join(asked, F.col("vec_id") == F.col("next")).select("query_id", "embedding")
    passage = nearest(q, v, N_RETRIEVE).select("query_id", F.col("vec_id").alias("id"), F.lit("passage").alias("list"), "rank", F.lit(PASSAGE_WEIGHT).alias("weight"))
    f = R.fuse(_lists(spark, folder).unionByName(passage))
    return f.select("query_id", F.col("id").alias("row_id"), half_up(F.col("rrf"), 6).alias("rrf"), "overlap")


def _boosted(spark: SparkSession, folder: str) -> DataFrame:
    mode = R.MODES["background"]
    f = R.fuse(_lists(spark, folder))
    n = read_table(spark, folder, "nuggets").select(
        F.col("row_id").alias("id"), "nugget_id", key_of("paper_id").alias("paper_key"), F.lower("type").alias("type"),
        "section", "thesis_relevance", "overall_score",
    )
    p = papers(spark, folder, "year", "citation_count", "influential_citation_count", "paper_type").select(
        "paper_key", "year", "title", "citation_count", "influential_citation_count", "paper_type", F.lit(True).alias("known")
    )
    votes = _votes(spark, folder)
    by_nugget = votes.groupBy("nugget_key").agg(F.sum("rating").alias("nugget_votes"))
    by_paper = votes.where("paper_key IS NOT NULL").groupBy("paper_key").agg(F.sum("rating").alias("paper_votes"))
    totals = nuggets(spark, folder, "paper_id", "question", "type", "section", "thesis_relevance", "overall_score").groupBy(key_of("paper_id").alias("paper_key")).agg(F.count(F.lit(1)).alias("paper_total"))
    rows = f.join(n, "id").withColumn("nugget_key", key_of("nugget_id"))
    hits = rows.groupBy("query_id", "paper_key").agg(F.count(F.lit(1)).alias("paper_hits"))
    rows = (
        rows.join(hits.where("paper_key IS NOT NULL"), ["query_id", "paper_key"], "left")
        .join(p, "paper_key", "left")
        .join(by_nugget, "nugget_key", "left")
        .join(by_paper, "paper_key", "left")
        .join(totals, "paper_key", "left")
        .join(read_table(spark, folder, "nuggets").select(F.col("row_id").alias("query_id"), F.col("question").alias("asked")), "query_id", "left")
    )
    targets = F.array(F.lit("background"), F.lit("method"))
    score = (
        F.col("rrf")
        * R.relevance_boost(F.col("thesis_relevance"))
        * R.section_boost(F.col("section"), mode["preferred_sections"])
        * R.type_boost(F.col("type"), targets)
        * R.feedback_boost(F.col("nugget_votes"))
        * R.paper_feedback_boost(F.col("paper_votes"))
        * F.coalesce(R.depth_boost(F.col("paper_hits"), F.coalesce("paper_total", F.lit(1))), F.lit(1.0))
        * R.authority_boost(
            F.coalesce("known", F.lit(False)), F.col("year"), F.col("title"), F.col("citation_count"),
            F.col("influential_citation_count"), F.col("paper_type"), mode["authority"], mode["review"],
        )
        * R.quality_boost(F.col("overall_score"))
        * F.coalesce(R.title_boost(F.col("asked"), F.col("title"), TITLE_STOPWORDS), F.lit(1.0))
    )
    return rows.withColumn("score", score)


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    """The last rating of each (nugget, query), kept within -1..1."""
    from lodestone.plans.kb import feedback_log

    return feedback_log(spark, folder)


def hybrid_boosted(spark: SparkSession, folder: str) -> DataFrame:
    """Fused scores of every 50th vector times all boosts of the mode ``background``."""
    return _boosted(spark, folder).select("query_id", F.col("id").alias("row_id"), half_up(F.col("score"), 6).alias("score"))


def rerank_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Fused lists reranked by the share of the query's words that a nugget holds."""
    n = read_table(spark, folder, "nuggets")
    words = F.array_distinct(F.regexp_extract_all(F.lower(qa()), F.lit("[a-z0-9]+"), 0))
    asked = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("question", F.lit(""))), F.lit("[a-z0-9]+"), 0))
    held = n.select(F.col("row_id").alias("id"), words.alias("w"))
    query = n.select(F.col("row_id").alias("query_id"), asked.alias("q"))
    f = R.fuse(_lists(spark, folder)).join(held, "id").join(query, "query_id")
    scored = f.withColumn("ce", F.size(F.array_intersect("w", "q")) / F.greatest(F.size("q"), F.lit(1)))
    out = R.blend(scored.select("query_id", "id", "rrf", "ce"))
    return out.select("query_id", F.col("id").alias("row_id"), half_up(F.col("blended"), 6).alias("blended"))


def diversity_select(spark: SparkSession, folder: str) -> DataFrame:
    """A varied choice of 16 nuggets per query from the boosted candidates."""
    rows = _boosted(spark, folder).select("query_id", "id", "score", "type", F.col("paper_key").alias("paper_id"))
    return R.diverse(rows, 16, R.MODES["background"]["max_per_paper"]).withColumnRenamed("id", "row_id")


def pinned_select(spark: SparkSession, folder: str) -> DataFrame:
    """The nuggets of the three most cited papers that would be pinned to a context."""
    p = papers(spark, folder, "citation_count").orderBy(F.col("citation_count").desc_nulls_last(), "paper_key").limit(3).select("paper_key")
    score = F.when(F.col("overall_score").between(1, 5), F.col("overall_score")).otherwise(0.0)
    n = nuggets(spark, folder, "paper_id", "type", "overall_score").withColumn("paper_key", key_of("paper_id")).join(p, "paper_key", "left_semi")
    rows = n.select(
        F.col("nugget_id").alias("id"), F.col("paper_key").alias("paper_id"), F.lower(F.coalesce("type", F.lit(""))).alias("type"), score.alias("score")
    )
    return R.pinned(rows).select(F.col("id").alias("nugget_id"), "type", "score")


def paper_shortcut(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nuggets to answer from when a question names one paper (the one with most
    nuggets): those of preferred sections first, then by relevance and score."""
    n = nuggets(spark, folder, "paper_id", "section", "thesis_relevance", "overall_score").withColumn("paper_key", key_of("paper_id")).where("paper_key IS NOT NULL")
    top = n.groupBy("paper_key").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "paper_key").limit(1).select("paper_key")
    score = F.when(F.col("overall_score").between(1, 5), F.col("overall_score")).otherwise(-1.0)
    preferred = F.lower(F.coalesce("section", F.lit(""))).isin("results", "experiments", "method", "discussion")
    r = n.join(top, "paper_key", "left_semi").select("nugget_id", preferred.alias("preferred"), F.coalesce("thesis_relevance", F.lit(0)).alias("relevance"), score.alias("score"))
    return r.orderBy(F.col("preferred").desc(), F.col("relevance").desc(), F.col("score").desc(), "nugget_id").limit(20)


def prompt_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The sources block of a prompt from the nearest nuggets, one text per query vector."""
    v = _vectors(spark, folder)
    q = v.where("vec_id IN (1, 2, 3)").withColumnRenamed("vec_id", "query_id")
    n = read_table(spark, folder, "nuggets").select(F.col("row_id").alias("vec_id"), "nugget_id", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("answer", F.lit("")).alias("answer"))
    one = F.format_string('<source id="%s" type="%s">%s</source>', "nugget_id", "type", "answer")
    h = nearest(q, v.join(n.select("vec_id"), "vec_id", "left_semi"), 5).join(n, "vec_id")
    g = h.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("s")))).alias("r"))
    return g.select("query_id", F.concat(F.lit("<sources>"), F.array_join(F.transform("r", lambda x: x["s"]), "\n"), F.lit("</sources>")).alias("prompt"))


def anchor_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """The best cosine similarity of each vector to five anchors."""
    v = _vectors(spark, folder)
    anchors = v.where("vec_id BETWEEN 1 AND 5").agg(F.collect_list("embedding").alias("a"))  # five rows
    best = F.array_max(F.transform("a", lambda x: cosine_similarity(x, F.col("embedding"))))
    return v.withColumn("a", anchors.scalar()).select("vec_id", half_up(best).alias("similarity"))


# Words of comparing and of defining questions.
COMPARE = (
    r"(?i)\b(compar|vs\.?|versus|differ|trade.?offs?|advantage|disadvantage|better|worse|outperform|benchmark|against"
    r"|relative to|between .+ and)\b"
)
DEFINE = r"(?i)\b(what is|what are|define|definition|explain|concept|principle|how does .* work|overview|introduction|fundamentals)\b"


def query_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Routing of all distinct nugget questions: comparison, definition, BM25 weight."""
    q = nuggets(spark, folder, "question").select("question").where("trim(question) <> ''").distinct()
    compare, define = F.col("question").rlike(COMPARE), F.col("question").rlike(DEFINE)
    weight = F.least(F.greatest(1 + F.when(compare, 0.5).otherwise(0.0) - F.when(define, 0.3).otherwise(0.0), F.lit(0.5)), F.lit(2.0))
    tokens = F.size(F.split(F.trim("question"), r"\s+"))
    return (
        q.select(
            compare.alias("comparison"), define.alias("definitional"), half_up(weight, 2).alias("bm25_weight"), (tokens < 8).alias("short")
        )
        .groupBy("comparison", "definitional", "bm25_weight", "short")
        .agg(F.count(F.lit(1)).alias("questions"))
    )


_COS = "1 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_E = _COS.format(a="q.embedding", b="e.embedding")
_KNN_OUT = f"""
SELECT nugget_id, type, section, title, CAST(year AS VARCHAR) AS year, {half_up_sql("d")} AS distance
FROM top LEFT JOIN p ON p.paper_key = top.paper_key
"""
_QA = "(coalesce(question, '') || ' ' || coalesce(answer, ''))"


def _bm25_sql(queries: str, texts: str, key: str, k: int, mode: str) -> str:
    """CTEs ending in bm(query_id, id, score, rank)."""
    having = "HAVING count(*) = any_value(nu)" if mode == "and" else ""
    return f"""
qs AS ({queries}),
units AS (
  SELECT DISTINCT query_id, array_to_string(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+'), ' ') AS unit
  FROM (SELECT query_id, unnest(string_split_regex(lower(replace(query, '"', '')), '\\s+')) AS t FROM qs)
  WHERE regexp_matches(t, '[\\p{{L}}\\p{{N}}]')
),
nunits AS (SELECT query_id, count(*) AS nu FROM units GROUP BY 1),
texts AS (SELECT {key} AS id, regexp_extract_all(lower({_QA}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {texts}),
stats AS (SELECT count(*)::DOUBLE AS n_all, avg(len(w)::DOUBLE) AS avgdl FROM texts),
grams AS (
  SELECT id, unnest(w) AS unit FROM texts
  UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM texts
  UNION ALL SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) FROM texts
),
tfs AS (SELECT id, unit, count(*) AS tf FROM grams WHERE unit IN (SELECT unit FROM units) GROUP BY 1, 2),
dfs AS (SELECT unit, count(*)::DOUBLE AS n FROM tfs GROUP BY 1),
sc AS (
  SELECT u.query_id, t.id, sum(greatest(ln((n_all - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * len(x.w)::DOUBLE / avgdl))) AS score
  FROM units u JOIN tfs t USING (unit) JOIN dfs USING (unit) JOIN texts x ON x.id = t.id
  JOIN nunits nn ON nn.query_id = u.query_id CROSS JOIN stats
  GROUP BY 1, 2 {having.replace("nu)", "nn.nu)")}
),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9) DESC, id) AS rank FROM sc
  QUALIFY rank <= {k})"""


_FUSED = f"""
vec AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_E}, e.vec_id) AS rank
  FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id > 0 QUALIFY rank <= {N_RETRIEVE}
),{_bm25_sql('''SELECT row_id AS query_id, question AS query
  FROM nuggets WHERE row_id % 50 = 0 AND row_id > 0 AND row_id IN (SELECT vec_id FROM embeddings)''', "nuggets", "row_id", N_RETRIEVE, "or")},
fused AS (
  SELECT query_id, id, sum(1.0::DOUBLE / (rank - 1 + 30)) AS rrf, count(*) AS overlap
  FROM (SELECT query_id, id, rank FROM vec UNION ALL SELECT query_id, id, rank FROM bm) GROUP BY 1, 2
)"""

_TW = (
    "list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]+')), lambda w: length(w) >= 4 AND w NOT IN ("
    + ", ".join(f"'{w}'" for w in TITLE_STOPWORDS)
    + "))"
)
_BOOSTED = f"""
WITH {N}, {P}, {_FUSED},
fb AS (
  SELECT lower(trim(nugget_id)) AS nugget_key, query, arg_max(rating, (ts, feedback_id)) AS rating,
    arg_max(lower(trim(paper_id)), (ts, feedback_id)) AS paper_key
  FROM (SELECT *, coalesce(CASE WHEN regexp_matches(created_at, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$')
      THEN CAST(timezone('UTC', CAST(created_at AS TIMESTAMPTZ)) AS TIMESTAMP)
      ELSE TRY_CAST(created_at AS TIMESTAMP) END, TIMESTAMP '0001-01-01') AS ts FROM nugget_feedback
    WHERE trim(nugget_id) <> '' AND trim(query) <> '' AND rating BETWEEN -1 AND 1)
  GROUP BY 1, 2
),
nv AS (SELECT nugget_key, sum(rating) AS nugget_votes FROM fb GROUP BY 1),
pv AS (SELECT paper_key, sum(rating) AS paper_votes FROM fb WHERE paper_key IS NOT NULL GROUP BY 1),
pt AS (SELECT lower(trim(paper_id)) AS paper_key, count(*) AS paper_total FROM n WHERE trim(paper_id) <> '' GROUP BY 1),
rows AS (
  SELECT f.query_id, f.id, f.rrf, x.*, CASE WHEN trim(x.paper_id) <> '' THEN lower(trim(x.paper_id)) END AS paper_key
  FROM fused f JOIN nuggets x ON x.row_id = f.id
),
hits AS (SELECT query_id, paper_key, count(*) AS h FROM rows WHERE paper_key IS NOT NULL GROUP BY 1, 2),
boosted AS (
  SELECT r.query_id, r.id, lower(r.type) AS type, r.paper_key, rrf
    * coalesce(1 + (CASE WHEN r.thesis_relevance > 0 THEN r.thesis_relevance ELSE 3 END - 3) * 0.2::DOUBLE, 1)
    * CASE WHEN regexp_matches(lower(coalesce(r.section, '')), 'abstract|introduction|background|related work') THEN 1.15::DOUBLE ELSE 1 END
    * CASE WHEN lower(r.type) IN ('background', 'method') THEN 1.2::DOUBLE ELSE 1 END
    * CASE WHEN nugget_votes > 0 THEN 1.3::DOUBLE WHEN nugget_votes < 0 THEN 0.5 ELSE 1 END
    * CASE WHEN paper_votes > 0 THEN 1 + least(paper_votes * 0.05::DOUBLE, 0.3)
           WHEN paper_votes < 0 THEN greatest(1 + paper_votes * 0.1::DOUBLE, 0.3) ELSE 1 END
    * coalesce(1 + 0.3::DOUBLE * least(h / greatest(coalesce(paper_total, 1), 1)::DOUBLE, 1.0) + least(log2(h) / 5::DOUBLE, 0.3), 1)
    * CASE WHEN p.paper_key IS NULL THEN 1
           WHEN p.year IS NULL OR coalesce(p.title, '') = '' OR regexp_matches(p.title, '^\\d{{4}}[\\s_]\\d{{4,5}}$') THEN 0.3
           ELSE 1 + 1.5::DOUBLE * 0.1 * least(log10(greatest(coalesce(p.citation_count, 0), 1)), 4.0)
             + CASE WHEN p.influential_citation_count > 10 THEN 0.1 ELSE 0 END
             + CASE WHEN regexp_matches(lower(coalesce(p.paper_type, '')), 'review|survey') THEN 0.3 ELSE 0 END END
    * CASE WHEN r.overall_score > 0 AND NOT isnan(r.overall_score) THEN greatest(1 + (r.overall_score - 3) * 0.15::DOUBLE, 0.5) ELSE 1 END
    * CASE WHEN list_has_any({_TW.format(c="a.question")}, {_TW.format(c="p.title")}) THEN 2.0::DOUBLE ELSE 1 END AS score
  FROM rows r LEFT JOIN nuggets a ON a.row_id = r.query_id LEFT JOIN hits USING (query_id, paper_key) LEFT JOIN p ON p.paper_key = r.paper_key
  LEFT JOIN nv ON nv.nugget_key = lower(trim(r.nugget_id)) LEFT JOIN pv ON pv.paper_key = r.paper_key
  LEFT JOIN pt ON pt.paper_key = r.paper_key
)
"""

SQL = {
    "vector_topk_enriched": f"""
WITH {P}, top AS (
  SELECT x.*, lower(trim(x.paper_id)) AS paper_key, {_E} AS d
  FROM nuggets x JOIN embeddings e ON e.vec_id = x.row_id, (SELECT * FROM embeddings WHERE vec_id = 1) q
  WHERE lower(x.type) IN ('method', 'result') ORDER BY d, x.row_id LIMIT 20
) {_KNN_OUT}""",
    "vector_year_filter": f"""
WITH {P}, top AS (
  SELECT x.*, lower(trim(x.paper_id)) AS paper_key, {_E} AS d
  FROM nuggets x JOIN embeddings e ON e.vec_id = x.row_id, (SELECT * FROM embeddings WHERE vec_id = 3) q
  WHERE lower(trim(x.paper_id)) IN (SELECT paper_key FROM p WHERE year BETWEEN 2016 AND 2020) ORDER BY d, x.row_id LIMIT 15
) {_KNN_OUT}""",
    "vector_multi_query": f"""
WITH r AS (
  SELECT e.vec_id, {_E} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_E}, e.vec_id) AS k
  FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id IN (5, 50, 100)
), b AS (SELECT vec_id, min(d) AS d FROM r WHERE k <= 9 GROUP BY 1 ORDER BY 2, 1 LIMIT 18)
SELECT vec_id, {half_up_sql("d")} AS distance FROM b""",
    "knn_self_join": f"""
SELECT query_id, vec_id, {half_up_sql("d")} AS distance, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {_E} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_E}, e.vec_id) AS rank
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10)""",
    "bm25_search": f"""
WITH {N}, {_bm25_sql("SELECT 0 AS query_id, 'sparse sensor calibration' AS query", "n", "nugget_id", 50, "and")}
SELECT id AS nugget_id, {half_up_sql("score")} AS score, rank FROM bm""",
    "bm25_batch": f"""
WITH {N}, {_bm25_sql("SELECT feedback_id AS query_id, query FROM nugget_feedback WHERE feedback_id % 50 = 0 AND trim(query) <> ''", "n", "nugget_id", 10, "and")}
SELECT query_id, id AS nugget_id, {half_up_sql("score")} AS score, rank FROM bm""",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, id AS row_id, {half_up_sql('rrf', 6)} AS rrf, overlap FROM fused",
    "passage_fusion": f"""WITH {_FUSED}, ps AS (
  SELECT q.vec_id - 1 AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_E}, e.vec_id) AS rank
  FROM embeddings q CROSS JOIN embeddings e WHERE (q.vec_id - 1) % 50 = 0 AND q.vec_id > 1 AND q.vec_id - 1 IN (SELECT vec_id FROM embeddings) QUALIFY rank <= {N_RETRIEVE}
), u AS (
  SELECT query_id, id, 1.0::DOUBLE / (rank - 1 + 30) AS part FROM vec UNION ALL SELECT query_id, id, 1.0::DOUBLE / (rank - 1 + 30) FROM bm
  UNION ALL SELECT query_id, id, {PASSAGE_WEIGHT}::DOUBLE / (rank - 1 + 30) FROM ps
) SELECT query_id, id AS row_id, {half_up_sql('sum(part)', 6)} AS rrf, count(*) AS overlap FROM u GROUP BY 1, 2""",
    "hybrid_boosted": _BOOSTED + f"SELECT query_id, id AS row_id, {half_up_sql('score', 6)} AS score FROM boosted",
    "rerank_blend": f"""
WITH {_FUSED},
w AS (SELECT row_id, list_distinct(regexp_extract_all(lower({_QA}), '[a-z0-9]+')) AS w,
  list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9]+')) AS q FROM nuggets),
c AS (
  SELECT f.query_id, f.id, f.rrf, len(list_intersect(a.w, b.q)) / greatest(len(b.q), 1)::DOUBLE AS ce
  FROM fused f JOIN w a ON a.row_id = f.id JOIN w b ON b.row_id = f.query_id
), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) <= {R.RERANK_TOP} AS head FROM c)
SELECT query_id, id AS row_id, {half_up_sql('''CASE WHEN NOT head THEN rrf ELSE 0.4::DOUBLE * rrf + 0.6::DOUBLE * ((ce - min(ce) OVER w) /
  CASE WHEN max(ce) OVER w > min(ce) OVER w THEN max(ce) OVER w - min(ce) OVER w ELSE 1 END) * max(rrf) OVER w END''', 6)} AS blended
FROM h WINDOW w AS (PARTITION BY query_id, head)""",
    "pinned_select": f"""
WITH {N}, {P}, x AS (
  SELECT nugget_id, lower(trim(paper_id)) AS paper_key, lower(coalesce(type, '')) AS type,
    CASE WHEN overall_score BETWEEN 1 AND 5 THEN overall_score ELSE 0 END AS score FROM n
  WHERE lower(trim(paper_id)) IN (SELECT paper_key FROM p ORDER BY citation_count DESC NULLS LAST, paper_key LIMIT 3)
), a AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY paper_key, type ORDER BY score DESC, nugget_id) <= 4),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY paper_key ORDER BY score DESC, nugget_id) <= 15)
SELECT nugget_id, type, score FROM b ORDER BY score DESC, nugget_id LIMIT 20""",
    "paper_shortcut": f"""WITH {N}, t AS (SELECT lower(trim(paper_id)) AS k FROM n WHERE trim(paper_id) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT nugget_id, lower(coalesce(section, '')) IN ('results', 'experiments', 'method', 'discussion') AS preferred, coalesce(thesis_relevance, 0) AS relevance,
  CASE WHEN overall_score BETWEEN 1 AND 5 THEN overall_score ELSE -1 END AS score FROM n WHERE lower(trim(paper_id)) IN (SELECT k FROM t)
ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 LIMIT 20""",
    "prompt_sources": f"""WITH h AS (SELECT q.vec_id AS query_id, '<source id="' || x.nugget_id || '" type="' || coalesce(x.type, '') || '">' || coalesce(x.answer, '') || '</source>' AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_E}, e.vec_id) AS rank FROM embeddings q, embeddings e JOIN nuggets x ON x.row_id = e.vec_id
  WHERE q.vec_id IN (1, 2, 3) QUALIFY rank <= 5)
SELECT query_id, '<sources>' || string_agg(s, chr(10) ORDER BY rank) || '</sources>' AS prompt FROM h GROUP BY 1""",
    "anchor_similarity": f"""SELECT e.vec_id, {half_up_sql("max(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))")} AS similarity
FROM embeddings e, embeddings q WHERE q.vec_id BETWEEN 1 AND 5 GROUP BY 1""",
    "query_classify": f"""
WITH {N}, q AS (SELECT DISTINCT question FROM n WHERE trim(question) <> ''), c AS (
  SELECT regexp_matches(question, '{COMPARE}') AS comparison, regexp_matches(question, '{DEFINE}') AS definitional,
    len(string_split_regex(trim(question), '\\s+')) < 8 AS short FROM q
)
SELECT comparison, definitional, short, {half_up_sql('''least(greatest(1 + CASE WHEN comparison THEN 0.5::DOUBLE ELSE 0 END
  - CASE WHEN definitional THEN 0.3::DOUBLE ELSE 0 END, 0.5), 2.0)''', 2)} AS bm25_weight, count(*) AS questions
FROM c GROUP BY ALL""",
}

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk_enriched, vector_year_filter, vector_multi_query, knn_self_join, bm25_search, bm25_batch, rrf_fusion,
        hybrid_boosted, passage_fusion, rerank_blend, diversity_select, pinned_select, query_classify, paper_shortcut, prompt_sources, anchor_similarity,
    )
}
