"""Chunking, deduplication, incremental store, discovery and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import chunking, similarity, store
from lodestone.operators.lexical import bm25
from lodestone.plans.base import N, P, half_up_sql, nuggets, papers
from lodestone.plans.retrieval import _bm25_sql, qa
from lodestone.session import cut, half_up, key_of, read_table

SPLIT_AT = "2024-07-01 00:00:00"


def fixed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 100 tokens over all documents, overlapping by 20."""
    d = read_table(spark, folder, "documents").where("text IS NOT NULL")
    w = d.select("doc_id", F.explode(chunking.fixed_windows(F.col("text"), 100, 20)).alias("w"))
    return w.select("doc_id", F.col("w.start").cast("long").alias("token_start"), F.size("w.tokens").cast("long").alias("tokens"), F.md5(F.array_join("w.tokens", " ").cast("binary")).alias("digest"))


def flex_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of about 100 tokens that end at natural ends."""
    d = read_table(spark, folder, "documents")
    return chunking.flexible_windows(d, "doc_id", "text", 100, 20, 0.25).withColumnRenamed("id", "doc_id")


def _chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "chunks").select("paper_id", "chunk_id", "text", "section").where("text IS NOT NULL").distinct()


def section_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of chunks of one section within a paper, sections carried forward over nulls."""
    order = Window.partitionBy("paper_id").orderBy("chunk_id")
    c = read_table(spark, folder, "chunks").groupBy("paper_id", "chunk_id").agg(F.max("section").alias("section"))
    c = c.withColumn("section", F.coalesce(F.last("section", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("preamble")))
    c = c.withColumn("starts", F.when(F.lag("section").over(order).eqNullSafe(F.col("section")), 0).otherwise(1))
    c = c.withColumn("island", F.sum("starts").over(order))
    return c.groupBy("paper_id", "island", "section").agg(F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"), F.count(F.lit(1)).alias("chunks"))


def _word_sets(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower(qa()), F.lit(r"\S+"), 0))
    n = nuggets(spark, folder, "paper_id", "question", "answer").select(key_of("paper_id").alias("block"), F.col("nugget_id").alias("id"), words.alias("words"))
    return n.where("block IS NOT NULL AND size(words) > 0")


def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Nuggets of one paper that share more than 60 % of their words."""
    p = similarity.jaccard_pairs(_word_sets(spark, folder), 0.6)
    return p.select("id_a", "id_b", half_up(F.col("similarity")).alias("similarity"))


def greedy_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Nuggets that a greedy pass over each paper drops as duplicates of one that stays."""
    return similarity.greedy_keep(similarity.jaccard_pairs(_word_sets(spark, folder), 0.6)).withColumnRenamed("id", "nugget_id")


def near_dup_vs_existing(spark: SparkSession, folder: str) -> DataFrame:
    """Nuggets of later loads that are alike to more than 75 % to an earlier one of their paper,
    or to another later one that stays (a greedy pass in the order of ids)."""
    late = nuggets(spark, folder).select(F.col("nugget_id").alias("id"), (F.col("ingested_at") >= F.lit(SPLIT_AT).cast("timestamp_ntz")).alias("late"))
    p = similarity.jaccard_pairs(_word_sets(spark, folder), 0.75)
    p = p.join(late.select(F.col("id").alias("id_a"), F.col("late").alias("la")), "id_a").join(late.select(F.col("id").alias("id_b"), F.col("late").alias("lb")), "id_b")
    p = cut(p.where("la OR lb"))
    known = p.where("la <> lb").select(F.when(F.col("la"), F.col("id_a")).otherwise(F.col("id_b")).alias("id")).distinct()
    fresh = p.where("la AND lb").join(known.withColumnRenamed("id", "id_a"), "id_a", "left_anti").join(known.withColumnRenamed("id", "id_b"), "id_b", "left_anti")
    return known.unionByName(similarity.greedy_keep(fresh)).select(F.col("id").alias("nugget_id"))


def fuzzy_titles(spark: SparkSession, folder: str) -> DataFrame:
    """File names of papers matched to titles that are alike to 85 %."""
    p = papers(spark, folder)
    name = F.regexp_replace(F.regexp_extract("paper_id", r"_-_\d{4}_-_(.*)$", 1), "_", " ")
    files = p.select(F.col("paper_key").alias("id"), T.normal_title(name).alias("title")).where("title <> ''")
    titles = p.where("trim(title) <> ''").select(F.col("paper_key").alias("id"), T.normal_title(F.col("title")).alias("title"))
    pairs = similarity.fuzzy_title_join(files, titles)
    return pairs.select(F.col("id_a").alias("file_of"), F.col("id_b").alias("title_of"), half_up(F.col("ratio")).alias("ratio"))


def _loads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The nuggets as of the split date, and as of now."""
    from lodestone.plans.base import latest

    n = read_table(spark, folder, "nuggets").withColumn("paper_key", key_of("paper_id")).where("paper_key IS NOT NULL")
    n = n.withColumn("score", F.when(~F.isnan("overall_score"), F.col("overall_score").cast("decimal(6,2)")))
    old = latest(n.where(F.col("ingested_at") < F.lit(SPLIT_AT).cast("timestamp_ntz")), F.col("nugget_id"), "ingested_at", "row_id")
    new = latest(n, F.col("nugget_id"), "ingested_at", "row_id").where("removed_at IS NULL")
    return old, new


def change_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Papers whose nuggets are new, gone, changed or the same since the split date."""
    old, new = _loads(spark, folder)
    return store.changes(old, new, "paper_key", F.col("nugget_id"), F.col("question"), F.col("answer"), F.col("score"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Count and fingerprint of each paper's nuggets."""
    _, new = _loads(spark, folder)
    g = new.groupBy("paper_key").agg(*store.fingerprint(F.col("nugget_id"), F.col("question"), F.col("answer"), F.col("score")))
    return g.select("paper_key", "n", F.col("f1").cast("string").alias("f1"), F.col("f2").cast("string").alias("f2"))


def incremental_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The store after the later loads: their nuggets replace or join the earlier ones."""
    old, new = _loads(spark, folder)
    later = new.where(F.col("ingested_at") >= F.lit(SPLIT_AT).cast("timestamp_ntz"))
    cols = ["nugget_id", "paper_key", "row_id"]
    return store.upsert(old.select(*cols), later.select(*cols), ["nugget_id"])


def reuse_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """How many nuggets keep, change or lack their embedding, by type."""
    old, new = _loads(spark, folder)
    text = lambda d: d.select("nugget_id", F.concat_ws(":", "question", "answer").alias("content"))
    r = store.reuse(text(old), text(new), "nugget_id", "content")
    return r.groupBy("action").agg(F.count(F.lit(1)).alias("nuggets"))


def quality_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Nuggets flagged by their score (2 or less; none counts as 5)."""
    s = F.when(F.isnan("overall_score"), None).otherwise(F.col("overall_score"))
    return nuggets(spark, folder, "overall_score", "flagged").select("nugget_id", (F.coalesce(s, F.lit(5.0)) <= 2).alias("flagged")).where("flagged").select("nugget_id")


def ledger_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of papers from their repeated sightings."""
    p = read_table(spark, folder, "papers").withColumn("paper_key", key_of("paper_id")).where("paper_key IS NOT NULL")
    g = store.ledger(p, "paper_key", "added_at", "citation_count")
    return g.select("paper_key", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), "times_seen", F.coalesce("best_score", F.lit(-1)).alias("best_score"))


def override_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of nuggets raised to 3 for the weak ones of the type ``method``."""
    n = nuggets(spark, folder, "type", "overall_score").select("nugget_id", F.lower("type").alias("type"), F.when(F.col("overall_score").between(1, 5), F.col("overall_score")).alias("score"))
    better = n.where("type = 'method' AND score <= 2").select("nugget_id", F.lit(3.0).alias("score"))
    return store.override(n, better, "nugget_id", ["score"]).groupBy("type").agg(half_up(F.avg("score"), 3).alias("mean_score"), F.count(F.lit(1)).alias("nuggets"))


def quality_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Nuggets after rating: scores joined by id (none counts as 0 and is marked), papers whose
    scores are all 0 kept whole, weak ones (1 and 2) removed otherwise."""
    n = nuggets(spark, folder, "paper_id", "overall_score").select("nugget_id", key_of("paper_id").alias("paper_key")).where("paper_key IS NOT NULL")
    s = nuggets(spark, folder, "paper_id", "overall_score").where(F.col("overall_score").between(1, 5)).select("nugget_id", F.floor("overall_score").cast("int").alias("overall"))
    r = n.join(s, "nugget_id", "left").select("nugget_id", "paper_key", F.coalesce("overall", F.lit(0)).alias("overall"), F.col("overall").isNull().alias("unrated"))
    best = r.groupBy("paper_key").agg(F.max("overall").alias("best"))
    r = r.join(best, "paper_key")
    kept = (F.col("best") == 0) | ~F.col("overall").between(1, 2)
    return r.groupBy("paper_key").agg(
        F.count(F.when(kept, True)).alias("kept"), F.count(F.when(~kept, True)).alias("removed"), F.count(F.when(F.col("unrated"), True)).alias("unrated")
    )


def renumbered(spark: SparkSession, folder: str) -> DataFrame:
    """New running ids of each paper's nuggets, in the order of their chunks."""
    n = nuggets(spark, folder, "paper_id", "source_chunk", "removed_at").withColumn("paper_key", key_of("paper_id")).where("paper_key IS NOT NULL AND removed_at IS NULL")
    # Numbers run over the paper, but only a chunk's nuggets are sorted together: each chunk
    # begins after the nuggets of the chunks before it.
    n = n.select("nugget_id", "paper_key", F.coalesce("source_chunk", F.lit(-1)).alias("chunk"))
    before = n.groupBy("paper_key", "chunk").agg(F.count(F.lit(1)).alias("c"))
    chunks = Window.partitionBy("paper_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("paper_key", "chunk", F.coalesce(F.sum("c").over(chunks), F.lit(0)).alias("before"))
    k = F.col("before") + F.row_number().over(Window.partitionBy("paper_key", "chunk").orderBy("nugget_id")) - 1
    return n.join(before, ["paper_key", "chunk"]).select("nugget_id", F.concat("paper_key", F.lit("_"), k.cast("string")).alias("new_id"))


def candidate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Papers by the identifier that names them: arXiv, DOI or title; and repeated ones."""
    arxiv, doi = F.nullif(F.trim("arxiv_id"), F.lit("")), F.nullif(F.lower(F.trim("doi")), F.lit(""))
    p = read_table(spark, folder, "papers")
    k = F.when(arxiv.isNotNull(), F.concat(F.lit("arxiv:"), arxiv)).when(doi.isNotNull(), F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("title:"), T.normal_title(F.coalesce("title", F.lit("")))))
    g = p.select(k.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(F.substring_index("k", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("candidates"), F.sum(F.col("n") - 1).cast("long").alias("duplicates"))


TERMS = ("event-based", "sensor", "calibration", "sparse")


def keyword_authority_score(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate papers scored by keywords and authority, as of 2025."""
    title = F.lower(F.coalesce("title", F.lit("")))
    abstract = F.lower(F.coalesce("abstract", F.lit("")))
    points = sum((F.when(title.contains(t), 2).when(abstract.contains(t), 1).otherwise(0) for t in TERMS), F.lit(0))
    keyword = F.least(points / (2 * len(TERMS)), F.lit(1.0))
    cited = F.least(F.log2(1 + F.coalesce("citation_count", F.lit(0)).cast("double")) / 15, F.lit(1.0))
    recent = F.when(F.col("year") >= 2024, 0.15).when(F.col("year") >= 2022, 0.08).otherwise(0.0)
    authority = F.least(cited + recent, F.lit(1.0))
    p = read_table(spark, folder, "papers").withColumn("paper_key", key_of("paper_id")).where("paper_key IS NOT NULL")
    s = p.select("paper_key", half_up(0.6 * keyword + 0.4 * authority).alias("score"))
    best = s.groupBy("paper_key").agg(F.max("score").alias("score"))
    return best.orderBy(F.col("score").desc(), "paper_key").limit(100)


def _own_ranks(spark: SparkSession, folder: str) -> DataFrame:
    n = read_table(spark, folder, "nuggets").select("row_id", "question", "answer", "type")
    q = n.where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), F.col("question").alias("query"))
    hits = bm25(q, n, 50, query_id="query_id", query="query", text_id="row_id", text=qa(), mode="or", own=True)
    own = hits.where("query_id = id").select("query_id", "rank")
    kinds = n.select(F.col("row_id").alias("query_id"), F.coalesce(F.lower("type"), F.lit("(none)")).alias("type"))
    return q.select("query_id").join(kinds, "query_id").join(own, "query_id", "left")


def self_retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """How well every 50th question finds its own nugget, by type and overall."""
    found = lambda k: half_up(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))).alias(f"recall_{k}")
    g = _own_ranks(spark, folder).rollup("type").agg(F.count(F.lit(1)).alias("queries"), *[found(k) for k in (1, 5, 10, 20, 50)], half_up(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))).alias("mrr"))
    return g.withColumn("type", F.coalesce("type", F.lit("(all)"))).where("queries >= 3 OR type = '(all)'")


#: Rank buckets of the self-retrieval report: name, first and last rank.
RANK_BUCKETS = (("rank_1", 1, 1), ("rank_2_5", 2, 5), ("rank_6_10", 6, 10), ("rank_11_20", 11, 20), ("rank_21_50", 21, 50))


def self_retrieval_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Where every 50th question finds its own nugget, by section (those with three questions
    or more): rank buckets, and mean and median rank of those found."""
    sections = read_table(spark, folder, "nuggets").select(F.col("row_id").alias("query_id"), F.coalesce("section", F.lit("(none)")).alias("section"))
    r = _own_ranks(spark, folder).select("query_id", "rank").join(sections, "query_id")
    buckets = [F.count(F.when(F.col("rank").between(a, b), True)).alias(name) for name, a, b in RANK_BUCKETS]
    g = r.groupBy("section").agg(
        F.count(F.lit(1)).alias("queries"), *buckets, F.count(F.when(F.col("rank").isNull(), True)).alias("not_found"),
        half_up(F.avg("rank")).alias("mean_rank"), half_up(F.expr("percentile(rank, 0.5)")).alias("median_rank"),
    )
    return g.where("queries >= 3")


def canary_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out items by mode: for how many all their words of 3 or more letters find a document."""
    items = read_table(spark, folder, "canary_items")
    words = F.array_join(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]{3,}"), 0), " ")
    q = items.select(F.col("item_id").alias("query_id"), words.alias("query"))
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    hits = bm25(q, docs, 20, query_id="query_id", query="query", text_id="doc_id", text=F.coalesce("text", F.lit("")))
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    j = items.select(F.col("item_id").alias("query_id"), "mode").join(n, "query_id", "left")
    return j.groupBy("mode").agg(F.count(F.lit(1)).alias("items"), F.count("found").alias("with_hits"))


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """200 nuggets, each type in proportion and at least once, by seeded digest."""
    n = nuggets(spark, folder, "type").select("nugget_id", F.coalesce(F.lower("type"), F.lit("(none)")).alias("type"), F.md5(F.concat(F.lit("42:"), "nugget_id").cast("binary")).alias("r"))
    sizes = n.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    quota = F.greatest(F.floor(F.col("n") * 200 / F.col("total")), F.lit(1))
    quotas = sizes.withColumn("total", sizes.agg(F.sum("n")).scalar()).select("type", quota.alias("quota"))
    order = Window.partitionBy("type").orderBy("r", "nugget_id")
    picked = n.join(quotas, "type").withColumn("k", F.row_number().over(order)).where("k <= quota")
    return picked.select("nugget_id", "type")


_PK = "CASE WHEN trim(paper_id) <> '' THEN lower(trim(paper_id)) END"
_W = "list_distinct(regexp_extract_all(lower(coalesce(question, '') || ' ' || coalesce(answer, '')), '\\S+'))"
_PAIRS = f"""w AS (SELECT {_PK} AS block, nugget_id AS id, ingested_at >= TIMESTAMP '{SPLIT_AT}' AS late, {_W} AS w FROM n WHERE trim(paper_id) <> ''),
s AS (SELECT a.id AS id_a, b.id AS id_b, a.late AS la, b.late AS lb, len(list_intersect(a.w, b.w)) AS k, len(a.w) + len(b.w) AS t
  FROM w a JOIN w b ON a.block = b.block AND a.id < b.id
  WHERE len(a.w) >= 0.6 * len(b.w) AND len(b.w) >= 0.6 * len(a.w)),
pairs AS (SELECT *, k / (t - k)::DOUBLE AS similarity FROM s WHERE k / (t - k)::DOUBLE > 0.6)"""
_LOADS = f"""l AS (SELECT *, {_PK} AS paper_key, CASE WHEN NOT isnan(overall_score) THEN CAST(CAST(overall_score AS DECIMAL(6,2)) AS VARCHAR) END AS score FROM nuggets WHERE trim(paper_id) <> ''),
old AS (SELECT * FROM l WHERE ingested_at < TIMESTAMP '{SPLIT_AT}' QUALIFY row_number() OVER (PARTITION BY nugget_id ORDER BY ingested_at DESC, row_id DESC) = 1),
new AS (SELECT * FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY nugget_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) = 1) WHERE removed_at IS NULL)"""
_SUMS = "count(*) AS n, sum(CAST('0x' || substring(h, 1, 15) AS UBIGINT)::HUGEINT) AS f1, sum(CAST('0x' || substring(h, 16, 15) AS UBIGINT)::HUGEINT) AS f2"
_HASH = "md5(nugget_id || ':' || coalesce(question, '') || ':' || coalesce(answer, '') || ':' || coalesce(score, ''))"

SQL = {
    "fixed_chunks": """WITH d AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 100) / 80.0), 0) AS BIGINT) + 1)) * 80 AS token_start FROM d WHERE len(w) > 0)
SELECT doc_id, token_start, len(w[token_start + 1:token_start + 100]) AS tokens, md5(array_to_string(w[token_start + 1:token_start + 100], ' ')) AS digest FROM s""",
    "section_islands": """WITH c AS (SELECT paper_id, chunk_id, max(section) AS section FROM chunks GROUP BY 1, 2),
f AS (SELECT paper_id, chunk_id, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING), 'preamble') AS section FROM c),
m AS (SELECT *, CASE WHEN lag(section) OVER w = section THEN 0 ELSE 1 END AS b FROM f WINDOW w AS (PARTITION BY paper_id ORDER BY chunk_id)),
i AS (SELECT *, CAST(sum(b) OVER (PARTITION BY paper_id ORDER BY chunk_id) AS BIGINT) AS island FROM m)
SELECT paper_id, island, section, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk, count(*) AS chunks FROM i GROUP BY 1, 2, 3""",
    "jaccard_pairs": f"WITH {N}, {_PAIRS} SELECT id_a, id_b, {half_up_sql('similarity')} AS similarity FROM pairs",
    "greedy_dedup": f"""WITH RECURSIVE {N}, {_PAIRS},
nodes AS (SELECT DISTINCT id FROM (SELECT id_a AS id FROM pairs UNION ALL SELECT id_b FROM pairs)),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM nodes),
e AS (SELECT x.k AS a, y.k AS b FROM pairs JOIN o x ON x.id = id_a JOIN o y ON y.id = id_b),
g AS (SELECT b, list(a) AS before FROM e GROUP BY 1),
r(k, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT r.k + 1, CASE WHEN list_has_any(coalesce(g.before, []::BIGINT[]), r.kept) THEN r.kept ELSE list_append(r.kept, r.k + 1) END
  FROM r LEFT JOIN g ON g.b = r.k + 1 WHERE r.k < (SELECT count(*) FROM o)
), final AS (SELECT kept FROM r ORDER BY k DESC LIMIT 1)
SELECT o.id AS nugget_id FROM o, final WHERE NOT list_contains(final.kept, o.k)""",
    "near_dup_vs_existing": f"""WITH RECURSIVE {N}, {_PAIRS},
near AS (SELECT id_a, id_b, la, lb FROM pairs WHERE (la OR lb) AND similarity > 0.75),
known AS (SELECT DISTINCT CASE WHEN la THEN id_a ELSE id_b END AS id FROM near WHERE la <> lb),
fresh AS (SELECT id_a, id_b FROM near WHERE la AND lb AND id_a NOT IN (SELECT id FROM known) AND id_b NOT IN (SELECT id FROM known)),
nodes AS (SELECT DISTINCT id FROM (SELECT id_a AS id FROM fresh UNION ALL SELECT id_b FROM fresh)),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM nodes),
e AS (SELECT x.k AS a, y.k AS b FROM fresh JOIN o x ON x.id = id_a JOIN o y ON y.id = id_b),
g AS (SELECT b, list(a) AS before FROM e GROUP BY 1),
r(k, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT r.k + 1, CASE WHEN list_has_any(coalesce(g.before, []::BIGINT[]), r.kept) THEN r.kept ELSE list_append(r.kept, r.k + 1) END
  FROM r LEFT JOIN g ON g.b = r.k + 1 WHERE r.k < (SELECT count(*) FROM o)
), final AS (SELECT kept FROM r ORDER BY k DESC LIMIT 1)
SELECT id AS nugget_id FROM known
UNION ALL SELECT o.id FROM o, final WHERE NOT list_contains(final.kept, o.k)""",
    "change_detection": f"""WITH {_LOADS}, o AS (SELECT paper_key, {_SUMS.replace('h,', _HASH + ',')} FROM old GROUP BY 1),
w AS (SELECT paper_key, {_SUMS.replace('h,', _HASH + ',')} FROM new GROUP BY 1)
SELECT coalesce(o.paper_key, w.paper_key) AS paper_key, CASE WHEN o.n IS NULL THEN 'new' WHEN w.n IS NULL THEN 'deleted'
  WHEN o.n = w.n AND o.f1 = w.f1 AND o.f2 = w.f2 THEN 'unchanged' ELSE 'changed' END AS change
FROM o FULL JOIN w ON w.paper_key = o.paper_key""",
    "fingerprints": f"""WITH {_LOADS}, f AS (SELECT paper_key, {_SUMS.replace('h,', _HASH + ',')} FROM new GROUP BY 1)
SELECT paper_key, n, CAST(f1 AS VARCHAR) AS f1, CAST(f2 AS VARCHAR) AS f2 FROM f""",
    "incremental_upsert": f"""WITH {_LOADS}, later AS (SELECT * FROM new WHERE ingested_at >= TIMESTAMP '{SPLIT_AT}')
SELECT nugget_id, paper_key, row_id FROM old WHERE nugget_id NOT IN (SELECT nugget_id FROM later)
UNION ALL SELECT nugget_id, paper_key, row_id FROM later""",
    "reuse_embeddings": f"""WITH {_LOADS} SELECT CASE WHEN o.nugget_id IS NULL THEN 'added'
  WHEN concat_ws(':', w.question, w.answer) = concat_ws(':', o.question, o.answer) THEN 'reuse' ELSE 'changed' END AS action, count(*) AS nuggets
FROM new w LEFT JOIN old o ON o.nugget_id = w.nugget_id GROUP BY 1""",
    "quality_flag": f"WITH {N} SELECT nugget_id FROM n WHERE CASE WHEN overall_score IS NULL OR isnan(overall_score) THEN 5 ELSE overall_score END <= 2",
    "ledger_upsert": f"""SELECT lower(trim(paper_id)) AS paper_key, strftime(min(added_at), '%Y-%m-%d') AS first_seen, strftime(max(added_at), '%Y-%m-%d') AS last_seen,
  count(*) AS times_seen, coalesce(max(citation_count), -1) AS best_score FROM papers WHERE trim(paper_id) <> '' GROUP BY 1""",
    "override_merge": f"""WITH {N}, s AS (SELECT lower(type) AS type, CASE WHEN overall_score BETWEEN 1 AND 5 THEN overall_score END AS score FROM n)
SELECT type, {half_up_sql("avg(CASE WHEN type = 'method' AND score <= 2 THEN 3.0 ELSE score END)", 3)} AS mean_score, count(*) AS nuggets FROM s GROUP BY 1""",
    "quality_apply": f"""WITH {N}, r AS (SELECT {_PK} AS paper_key, CASE WHEN overall_score BETWEEN 1 AND 5 THEN CAST(floor(overall_score) AS INTEGER) ELSE 0 END AS o,
  NOT coalesce(overall_score BETWEEN 1 AND 5, false) AS u FROM n WHERE trim(paper_id) <> ''),
b AS (SELECT *, max(o) OVER (PARTITION BY paper_key) AS best FROM r)
SELECT paper_key, count(*) FILTER (WHERE best = 0 OR o NOT BETWEEN 1 AND 2) AS kept, count(*) FILTER (WHERE best > 0 AND o BETWEEN 1 AND 2) AS removed,
  count(*) FILTER (WHERE u) AS unrated FROM b GROUP BY 1""",
    "renumbered": f"""WITH {N} SELECT nugget_id, lower(trim(paper_id)) || '_' || CAST(row_number() OVER (PARTITION BY lower(trim(paper_id)) ORDER BY coalesce(source_chunk, -1), nugget_id) - 1 AS VARCHAR) AS new_id
FROM n WHERE trim(paper_id) <> '' AND removed_at IS NULL""",
    "candidate_keys": """WITH k AS (SELECT CASE WHEN trim(arxiv_id) <> '' THEN 'arxiv:' || trim(arxiv_id) WHEN trim(doi) <> '' THEN 'doi:' || lower(trim(doi))
  ELSE 'title:' || trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9\\s\\-]', '', 'g'), '\\s+', ' ', 'g')) END AS k FROM papers),
g AS (SELECT k, count(*) AS n FROM k GROUP BY 1)
SELECT split_part(k, ':', 1) AS kind, count(*) AS candidates, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g GROUP BY 1""",
    "keyword_authority_score": f"""WITH s AS (SELECT lower(trim(paper_id)) AS paper_key, {half_up_sql('''0.6::DOUBLE * least((''' + " + ".join(
        f"CASE WHEN contains(lower(coalesce(title, '')), '{t}') THEN 2 WHEN contains(lower(coalesce(abstract, '')), '{t}') THEN 1 ELSE 0 END" for t in TERMS)
        + ''') / 8::DOUBLE, 1.0) + 0.4::DOUBLE * least(least(log2(1 + coalesce(citation_count, 0)) / 15, 1.0)
  + CASE WHEN year >= 2024 THEN 0.15::DOUBLE WHEN year >= 2022 THEN 0.08 ELSE 0 END, 1.0)''')} AS score FROM papers WHERE trim(paper_id) <> '')
SELECT paper_key, max(score) AS score FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
    "self_retrieval_metrics": f"""WITH {_bm25_sql("SELECT row_id AS query_id, question AS query FROM nuggets WHERE row_id % 50 = 0", "nuggets", "row_id", 50, "or")},
r AS (SELECT coalesce(lower(type), '(none)') AS type, rank FROM nuggets x LEFT JOIN bm ON bm.query_id = x.row_id AND bm.id = x.row_id WHERE x.row_id % 50 = 0)
SELECT coalesce(type, '(all)') AS type, count(*) AS queries, {", ".join(half_up_sql(f"avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END)") + f" AS recall_{k}" for k in (1, 5, 10, 20, 50))},
  {half_up_sql("avg(coalesce(1.0::DOUBLE / rank, 0))")} AS mrr FROM r GROUP BY ROLLUP (type) HAVING count(*) >= 3 OR grouping(type) = 1""",
    "self_retrieval_ranks": f"""WITH {_bm25_sql("SELECT row_id AS query_id, question AS query FROM nuggets WHERE row_id % 50 = 0", "nuggets", "row_id", 50, "or")},
r AS (SELECT coalesce(section, '(none)') AS section, rank FROM nuggets x LEFT JOIN bm ON bm.query_id = x.row_id AND bm.id = x.row_id WHERE x.row_id % 50 = 0)
SELECT section, count(*) AS queries, {", ".join(f"count(*) FILTER (rank BETWEEN {a} AND {b}) AS {name}" for name, a, b in RANK_BUCKETS)},
  count(*) FILTER (rank IS NULL) AS not_found, {half_up_sql("avg(rank)")} AS mean_rank, {half_up_sql("median(rank)")} AS median_rank
FROM r GROUP BY 1 HAVING count(*) >= 3""",
    "canary_recall": f"""WITH {_bm25_sql("SELECT item_id AS query_id, array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}_]{3,}'), ' ') AS query FROM canary_items", "documents", "doc_id", 20, "and").replace("(coalesce(question, '') || ' ' || coalesce(answer, ''))", "coalesce(text, '')")},
h AS (SELECT DISTINCT query_id FROM bm)
SELECT mode, count(*) AS items, count(h.query_id) AS with_hits FROM canary_items LEFT JOIN h ON h.query_id = item_id GROUP BY 1""",
    "stratified_sample": f"""WITH {N}, t AS (SELECT nugget_id, coalesce(lower(type), '(none)') AS type, md5('42:' || nugget_id) AS r FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY r, nugget_id) AS k, count(*) OVER (PARTITION BY type) AS c, count(*) OVER () AS total FROM t)
SELECT nugget_id, type FROM k WHERE k <= greatest(floor(c * 200 / total::DOUBLE), 1)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        fixed_chunks, flex_chunks, section_islands, jaccard_pairs, greedy_dedup, near_dup_vs_existing, fuzzy_titles,
        change_detection, fingerprints, incremental_upsert, reuse_embeddings, quality_flag, ledger_upsert, override_merge,
        quality_apply, renumbered, candidate_keys, keyword_authority_score, self_retrieval_metrics, self_retrieval_ranks, canary_recall, stratified_sample,
    )
}
