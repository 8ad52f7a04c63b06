"""Queries of the training-data operators over the knowledge-base tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.capping import cap_per_contributor
from lodestone.llm.defects import pair_defects
from lodestone.llm.leakage import leaked_items, words_sql
from lodestone.llm.lookalikes import BLANK, form_sql, look_classes, look_groups, look_pairs, unified_forms
from lodestone.llm.mixing import mix_sources
from lodestone.llm.neardup import expanded_pairs, near_duplicates
from lodestone.llm.scan_noise import chunk_noise, repaired_chunks
from lodestone.llm.splitting import split_texts
from lodestone.session import cut, key_of, read_table

PAPER_CAP = 40


def _capped(spark: SparkSession, folder: str) -> DataFrame:
    nuggets = read_table(spark, folder, "nuggets")
    return cap_per_contributor(
        nuggets,
        key_of("paper_id"),
        F.col("nugget_id"),
        F.col("overall_score"),
        max_count=PAPER_CAP,
        version=[F.col("ingested_at"), F.col("row_id")],
        low=1.0,
        high=5.0,
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Nuggets dropped by a cap of 40 per paper."""
    return _capped(spark, folder).where("NOT kept").select(F.col("id").alias("nugget_id"))


def p1_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Every nugget with its paper's key and whether it stays."""
    return _capped(spark, folder).select(
        F.col("id").alias("nugget_id"), F.col("owner").alias("paper_key"), "score", "kept"
    )


_P1 = """
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY nugget_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS v
  FROM nuggets WHERE trim(paper_id) <> ''
), ranked AS (
  SELECT nugget_id, lower(trim(paper_id)) AS paper_key,
    CASE WHEN overall_score BETWEEN 1 AND 5 AND NOT isnan(overall_score) THEN overall_score END AS score,
  FROM latest WHERE v = 1
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY paper_key ORDER BY score DESC NULLS LAST, nugget_id) AS place FROM ranked
)
"""

CHUNK_LIMIT = 400
CHUNK_OVERLAP = 50


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all chunks, at most 400 tokens each, overlapping by 50."""
    chunks = read_table(spark, folder, "chunks").select("paper_id", "chunk_id", "text")
    return split_texts(chunks, "text", limit=CHUNK_LIMIT, overlap=CHUNK_OVERLAP)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of more than 400 tokens."""
    return p6_pieces(spark, folder).where("n_pieces > 1 AND piece = 0").select("paper_id", "chunk_id").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of nuggets whose token sets are alike to three quarters."""
    nuggets = read_table(spark, folder, "nuggets")
    members, links = near_duplicates(nuggets, F.col("nugget_id"), F.col("question"), F.col("answer"), threshold=0.75)
    pairs = expanded_pairs(cut(members), cut(links))
    return pairs.select(F.col("id_a").alias("nugget_id_a"), F.col("id_b").alias("nugget_id_b"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every nugget with its class of equal texts (its least id) and the number of other
    classes that are nearly the same: the whole result without copies expanded into pairs."""
    nuggets = read_table(spark, folder, "nuggets")
    members, links = near_duplicates(nuggets, F.col("nugget_id"), F.col("question"), F.col("answer"), threshold=0.75)
    members, links = cut(members), cut(links)
    names = members.groupBy("cls").agg(F.min("id").alias("class_id"))
    ends = links.select(F.col("cls_a").alias("cls")).unionByName(links.select(F.col("cls_b").alias("cls")))
    counts = names.join(ends.groupBy("cls").agg(F.count(F.lit(1)).alias("links")), "cls", "left")
    out = members.join(counts, "cls")
    return out.select(F.col("id").alias("nugget_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Nuggets with a defective answer."""
    nuggets = read_table(spark, folder, "nuggets")
    found = pair_defects(nuggets, F.col("nugget_id"), F.col("question"), F.col("answer"))
    return found.select(F.col("id").alias("nugget_id"), "defect")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with traces of the printed page."""
    chunks = read_table(spark, folder, "chunks")
    found = chunk_noise(chunks, F.col("paper_id"), F.col("chunk_id"), F.col("text"))
    return found.select(F.col("paper").alias("paper_id"), F.col("chunk").alias("chunk_id"), "noise")


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks as continuous paragraphs."""
    chunks = read_table(spark, folder, "chunks")
    out = repaired_chunks(chunks, F.col("paper_id"), F.col("chunk_id"), F.col("text"))
    return out.select(F.col("paper").alias("paper_id"), F.col("chunk").alias("chunk_id"), "text")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, folder, "documents")
    targets = read_table(spark, folder, "mix_targets")
    return mix_sources(docs, F.col("doc_id"), F.col("text"), F.col("source"), targets, seed=42)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents selected for each source, with their repetitions."""
    return _mixed(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return _mixed(spark, folder)[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that look the same but are not equal."""
    docs = read_table(spark, folder, "documents")
    pairs = look_pairs(cut(look_classes(docs, F.col("doc_id"), F.col("text"))))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a look that several different texts share, with the look's numbers of
    texts and documents: the whole result without pairs."""
    docs = read_table(spark, folder, "documents")
    groups = look_groups(cut(look_classes(docs, F.col("doc_id"), F.col("text"))))
    return groups.select(F.col("id").alias("doc_id"), "look", "raw", "variants", "members")


def p9_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text in its consistent form."""
    docs = read_table(spark, folder, "documents")
    return unified_forms(docs, F.col("doc_id"), F.col("text")).select(F.col("id").alias("doc_id"), "form")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages of the held-out items."""
    docs = read_table(spark, folder, "documents")
    items = read_table(spark, folder, "canary_items")
    hits = leaked_items(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"))
    return hits.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


_GRAMS = """
SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g
FROM (SELECT {key}, string_split({words}, ' ') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12
"""

QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares, "p4_found": p4_found, "p4_repaired": p4_repaired, "p3_found": p3_found, "p2_found": p2_found, "p2_classes": p2_classes, "p7_found": p7_found, "p9_found": p9_found, "p9_forms": p9_forms, "p9_groups": p9_groups, "p6_found": p6_found, "p6_pieces": p6_pieces, "p1_found": p1_found, "p1_capped": p1_capped}
SQL = {
    "p2_found": """
WITH n AS (
  SELECT DISTINCT nugget_id, list_sort(list_distinct(regexp_extract_all(
    lower(coalesce(question, '') || ' ' || coalesce(answer, '')), '[a-z0-9]+'))) AS w FROM nuggets
), t AS (SELECT nugget_id, len(w) AS size, unnest(w) AS token FROM n),
freq AS (SELECT token, count(*) AS df FROM t GROUP BY token),
ranked AS (
  SELECT nugget_id, size, token, row_number() OVER (PARTITION BY nugget_id ORDER BY df, token) AS place
  FROM t JOIN freq USING (token)
), prefix AS (SELECT * FROM ranked WHERE place <= size - ceil(size * 0.75) + 1),
cand AS (
  SELECT DISTINCT a.nugget_id AS x, b.nugget_id AS y FROM prefix a JOIN prefix b USING (token)
  WHERE a.nugget_id < b.nugget_id AND a.size * 4 >= b.size * 3 AND b.size * 4 >= a.size * 3
), shared AS (SELECT x, y, len(list_intersect(a.w, b.w)) AS k, len(a.w) + len(b.w) AS s
  FROM cand JOIN n a ON a.nugget_id = x JOIN n b ON b.nugget_id = y)
SELECT x AS nugget_id_a, y AS nugget_id_b FROM shared WHERE k * 4 >= (s - k) * 3
""",
    "p2_classes": """
WITH n AS (
  SELECT DISTINCT nugget_id, lower(coalesce(question, '') || ' ' || coalesce(answer, '')) AS text
  FROM nuggets WHERE nugget_id IS NOT NULL
), m AS (SELECT nugget_id, min(nugget_id) OVER (PARTITION BY text) AS class_id, text FROM n WHERE regexp_matches(text, '[a-z0-9]')),
c AS (SELECT DISTINCT class_id, list_sort(list_distinct(regexp_extract_all(text, '[a-z0-9]+'))) AS w FROM m),
t AS (SELECT class_id, len(w) AS size, unnest(w) AS token FROM c),
freq AS (SELECT token, count(*) AS df FROM t GROUP BY token),
ranked AS (
  SELECT class_id, size, token, row_number() OVER (PARTITION BY class_id ORDER BY df, token) AS place
  FROM t JOIN freq USING (token)
), prefix AS (SELECT * FROM ranked WHERE place <= size - ceil(size * 0.75) + 1),
cand AS (
  SELECT DISTINCT a.class_id AS x, b.class_id AS y FROM prefix a JOIN prefix b USING (token)
  WHERE a.class_id < b.class_id AND a.size * 4 >= b.size * 3 AND b.size * 4 >= a.size * 3
), shared AS (SELECT x, y, len(list_intersect(a.w, b.w)) AS k, len(a.w) + len(b.w) AS s
  FROM cand JOIN c a ON a.class_id = x JOIN c b ON b.class_id = y),
linked AS (SELECT x, y FROM shared WHERE k * 4 >= (s - k) * 3),
ends AS (SELECT id, count(*) AS links FROM (SELECT x AS id FROM linked UNION ALL SELECT y FROM linked) GROUP BY id)
SELECT nugget_id, class_id, coalesce(links, 0) AS links FROM m LEFT JOIN ends ON ends.id = class_id
""",
    "p9_groups": f"""
WITH f AS (SELECT doc_id, text, {form_sql("text")} AS form FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, md5(form) AS look, md5(text) AS raw FROM f WHERE NOT regexp_matches(form, '{BLANK}')),
g AS (SELECT look, count(DISTINCT raw) AS variants, count(*) AS members FROM l GROUP BY look HAVING count(DISTINCT raw) > 1)
SELECT doc_id, look, raw, variants, members FROM l JOIN g USING (look)
""",
    "p7_found": f"""
SELECT DISTINCT doc_id, item_id
FROM ({_GRAMS.format(key="doc_id", words=words_sql("text"), table="documents")})
JOIN ({_GRAMS.format(key="item_id", words=words_sql("text"), table="canary_items")}) USING (g)
""",
    "p9_forms": f"SELECT doc_id, {form_sql('text')} AS form FROM documents",
    "p9_found": f"""
WITH f AS (SELECT doc_id, text, {form_sql("text")} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form
WHERE a.doc_id < b.doc_id AND a.text <> b.text AND NOT regexp_matches(a.form, '{BLANK}')
""",
    "p6_found": r"""
SELECT DISTINCT paper_id, chunk_id FROM chunks
WHERE len(regexp_extract_all(text, '[^\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]+')) > 400
""",
    "p1_found": _P1 + "SELECT nugget_id FROM placed WHERE place > 40",
    "p1_capped": _P1 + "SELECT nugget_id, paper_key, score, place <= 40 AS kept FROM placed",
}
