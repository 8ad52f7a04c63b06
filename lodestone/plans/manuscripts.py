"""Manuscripts, expected retrievals, and records from other places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import chunking, evaluation, store
from lodestone.operators.lexical import bm25
from lodestone.plans.base import N, P, half_up_sql, nuggets, papers
from lodestone.plans.curation import SPLIT_AT
from lodestone.plans.retrieval import _bm25_sql, qa
from lodestone.plans.textual import _SENT
from lodestone.session import half_up, key_of, read_table

#: Acronyms that the manuscripts' glossary defines: the kinds of nuggets.
GLOSSARY_KEYS = ("method", "result", "limitation", "background", "claim")


def _manuscripts(spark: SparkSession, folder: str) -> DataFrame:
    """paper_key, tex: LaTeX written from the tables, a piece per row. Every chunk of a paper is
    a figure (odd numbers: a table) with a label, every nugget refers to its source chunk and
    names its kind by a glossary command."""
    c = read_table(spark, folder, "chunks").select(key_of("paper_id").alias("paper_key"), "chunk_id", F.coalesce("section", F.lit("none")).alias("section"))
    env = F.when(F.col("chunk_id") % 2 == 1, "table").otherwise("figure")
    label = F.concat(F.when(F.col("chunk_id") % 2 == 1, "tab:").otherwise("fig:"), F.col("chunk_id").cast("string"))
    figure = F.concat(F.lit("\\begin{"), env, F.lit("}\n\\caption{"), F.col("section"), F.lit("}\n\\label{"), label, F.lit("}\n\\end{"), env, F.lit("}"))
    n = nuggets(spark, folder, "paper_id", "source_chunk", "type").withColumn("paper_key", key_of("paper_id"))
    ref = F.concat(F.when(F.col("source_chunk") % 2 == 1, "tab:").otherwise("fig:"), F.col("source_chunk").cast("string"))
    text = F.concat(F.lit("See \\ref{"), F.coalesce(ref, F.lit("eq:1")), F.lit("} for the \\gls{"), F.coalesce(F.regexp_replace(F.lower("type"), r"\W", ""), F.lit("none")), F.lit("}."))
    pieces = c.select("paper_key", figure.alias("tex")).unionByName(n.select("paper_key", text.alias("tex")))
    return pieces.where("paper_key IS NOT NULL")


def _labels_and_refs(spark: SparkSession, folder: str) -> DataFrame:
    """paper_key, name, label, ref: each name once, with whether it is defined and referred to."""
    m = _manuscripts(spark, folder)
    kind = lambda found, label: m.select("paper_key", F.explode(found(F.col("tex"))).alias("name"), F.lit(label).alias("defined"))
    both = kind(T.labels, True).unionByName(kind(T.label_refs, False))
    return both.groupBy("paper_key", "name").agg(F.max("defined").alias("label"), F.max(~F.col("defined")).alias("ref"))


def cross_references(spark: SparkSession, folder: str) -> DataFrame:
    """References without a label and labels without a reference, by paper."""
    issue = F.when(~F.col("label"), "broken_ref").otherwise("unused_label")
    return _labels_and_refs(spark, folder).where("NOT (label AND ref)").select("paper_key", issue.alias("issue"), "name")


def figure_discussion(spark: SparkSession, folder: str) -> DataFrame:
    """Figures and tables of each paper, those never referred to, and references to figures
    and tables that are not there."""
    m = _manuscripts(spark, folder)
    f = m.select("paper_key", F.explode(T.figures(F.col("tex"))).alias("f")).select("paper_key", "f.*").where("label IS NOT NULL").distinct()
    names = _labels_and_refs(spark, folder)
    seen = f.join(names.where("ref").select("paper_key", F.col("name").alias("label"), F.lit(1).alias("used")), ["paper_key", "label"], "left")
    count = lambda c, name: F.count(F.when(c, True)).alias(name)
    g = seen.groupBy("paper_key").agg(count(F.col("env") == "figure", "figures"), count(F.col("env") == "table", "tables"), count(F.col("used").isNull(), "not_referenced"))
    broken = names.where("NOT label").where(F.lower("name").rlike("fig:|tab:|table:|figure:")).groupBy("paper_key").agg(F.count(F.lit(1)).alias("broken_refs"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("figures", "tables", "not_referenced", "broken_refs")]
    return g.join(broken, "paper_key", "full_outer").select("paper_key", *zero)


def glossary_use(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that papers use without a definition, and definitions that no paper uses."""
    used = _manuscripts(spark, folder).select("paper_key", F.explode(T.glossary_uses(F.col("tex"))).alias("term")).distinct()
    counts = used.groupBy("term").agg(F.count(F.lit(1)).alias("papers"))
    defined = spark.createDataFrame([(k,) for k in GLOSSARY_KEYS], "term string").withColumn("defined", F.lit(True))
    status = F.when(F.col("defined").isNull(), "undefined").when(F.col("papers").isNull(), "unused").otherwise("used")
    return counts.join(defined, "term", "full_outer").select("term", status.alias("status"), F.coalesce("papers", F.lit(0)).alias("papers"))


# ---------------------------------------------------------------- expected retrievals


def _expected(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries of every 50th rating, the papers rated well for the same query, and the papers
    of the 20 nuggets that the query finds."""
    f = read_table(spark, folder, "nugget_feedback").where(F.trim("query") != "")
    q = f.where("feedback_id % 50 = 0").select(F.col("feedback_id").alias("query_id"), "query", F.coalesce(F.lower("mode"), F.lit("(none)")).alias("mode"))
    good = f.where("rating = 1").select("query", key_of("paper_id").alias("item"))
    n = read_table(spark, folder, "nuggets").select("row_id", "question", "answer", key_of("paper_id").alias("item"))
    hits = bm25(q.select("query_id", "query"), n, 20, query_id="query_id", query="query", text_id="row_id", text=qa(), mode="or")
    found = hits.join(n.select(F.col("row_id").alias("id"), "item"), "id").select("query_id", "item")
    return q, q.join(good, "query").select("query_id", "item"), found


def expected_recall(spark: SparkSession, folder: str) -> DataFrame:
    """By mode: queries with expected papers, their mean recall, how many are found whole
    (passed) and not at all."""
    q, expected, found = _expected(spark, folder)
    r = evaluation.expected_recall(expected, found).join(q.select("query_id", "mode"), "query_id")
    return r.groupBy("mode").agg(
        F.count(F.lit(1)).alias("queries"), half_up(F.avg("recall")).alias("mean_recall"),
        F.count(F.when(F.col("passed"), True)).alias("passed"), F.count(F.when(F.col("found") == 0, True)).alias("zero"),
    )


def expected_missing(spark: SparkSession, folder: str) -> DataFrame:
    """The papers that were expected of a query and not found."""
    _, expected, found = _expected(spark, folder)
    return evaluation.missing_items(expected, found).select("query_id", F.col("item").alias("paper_key"))


def citations_for_text(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 best nuggets of the whole collection for each sentence of at least 5 words of
    every 50th document."""
    d = read_table(spark, folder, "documents").where("doc_id % 50 = 0 AND text IS NOT NULL")
    s = d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("k", "sentence")).where(T.whitespace_words(F.col("sentence")) >= 5)
    q = s.select(F.concat("doc_id", F.lit(":"), "k").alias("query_id"), "doc_id", F.col("k").cast("long").alias("sentence_no"), "sentence")
    n = read_table(spark, folder, "nuggets").select("row_id", "question", "answer", "nugget_id")
    hits = bm25(q, n, 5, query_id="query_id", query="sentence", text_id="row_id", text=qa(), mode="or")
    out = hits.join(q.select("query_id", "doc_id", "sentence_no"), "query_id").join(n.select(F.col("row_id").alias("id"), "nugget_id"), "id")
    return out.select("doc_id", "sentence_no", "rank", "nugget_id")


# ---------------------------------------------------------------- papers and records


def find_papers_any(spark: SparkSession, folder: str) -> DataFrame:
    """Papers whose title, authors or id hold a text, from a year on."""
    hit = F.lit(False)
    for c in ("title", "authors", "paper_id"):
        hit = hit | F.coalesce(F.col(c).ilike("%grid%"), F.lit(False))
    return papers(spark, folder, "authors", "year").where(hit & (F.col("year") >= 2016)).select("paper_key", "year")


def preferred_nuggets(spark: SparkSession, folder: str) -> DataFrame:
    """How many nuggets each paper brings: the reviewed ones (flag set to 0) of a paper that
    has any, else its raw ones, weak scores among them improved, and later ones added."""
    n = nuggets(spark, folder, "paper_id", "flagged", "overall_score").select(
        "nugget_id", key_of("paper_id").alias("paper_key"), "flagged", F.when(F.col("overall_score").between(1, 5), F.col("overall_score")).alias("score"), "ingested_at"
    ).where("paper_key IS NOT NULL")
    cols = ["nugget_id", "paper_key", "score"]
    later = F.col("ingested_at") >= F.lit(SPLIT_AT).cast("timestamp_ntz")
    raw = n.where(~later)
    better = raw.where("score <= 2").select("nugget_id", F.lit(3.0).alias("score"))
    unified = n.where((F.col("flagged") == 0) & later).select(*cols)
    out = store.preferred(unified, raw.select(*cols), "paper_key", "nugget_id", better, n.where(later & (F.coalesce("flagged", F.lit(1)) != 0)).select(*cols))
    return out.groupBy("paper_key").agg(F.count(F.lit(1)).alias("nuggets"), half_up(F.avg("score"), 3).alias("mean_score"))


def manifest_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Every paper's last metadata, empty fields filled from its first: abstracts below 50
    characters count as empty."""
    p = read_table(spark, folder, "papers").withColumn("paper_key", key_of("paper_id")).where("paper_key IS NOT NULL")
    first = p.groupBy("paper_key").agg(F.min(F.struct("added_at", "title", "abstract", "doi", "year")).alias("r")).select("paper_key", "r.abstract", "r.doi", "r.year")
    last = papers(spark, folder, "abstract", "doi", "year").select("paper_key", "abstract", "doi", "year")
    merged = store.fill_empty(last, first, "paper_key", ["doi", "year"])
    merged = store.fill_empty(merged, first, "paper_key", ["abstract"], least=50)
    return merged.select("paper_key", F.md5(F.coalesce("abstract", F.lit("")).cast("binary")).alias("abstract"), "doi", "year")


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Sightings of papers with their status: downloaded where they have chunks, removed,
    else new."""
    p = read_table(spark, folder, "papers").withColumn("paper_key", key_of("paper_id")).where("paper_key IS NOT NULL")
    g = store.ledger(p, "paper_key", "added_at", "influential_citation_count")
    more = p.groupBy("paper_key").agg(F.max("citation_count").alias("citations"), F.count("removed_at").alias("gone"))
    have = read_table(spark, folder, "chunks").select(key_of("paper_id").alias("paper_key")).distinct().withColumn("have", F.lit(True))
    j = g.join(more, "paper_key").join(have, "paper_key", "left")
    return j.withColumn("status", F.when(F.col("have"), "downloaded").when(F.col("gone") > 0, "removed").otherwise("new"))


def ledger_status(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the ledger by status."""
    return _ledger(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("entries"), F.sum("times_seen").alias("sightings"))


def ledger_top(spark: SparkSession, folder: str) -> DataFrame:
    """The first 20 entries with a score of at least 2, in each of the ledger's orders."""
    e = _ledger(spark, folder).where("best_score >= 2")
    out = None
    for by in ("score", "citations", "recent", "seen"):
        top = store.ledger_order(e, by).limit(20).withColumn("rank", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))  # 20 rows
        part = top.select(F.lit(by).alias("sorted_by"), F.col("rank").cast("long").alias("rank"), "paper_key")
        out = part if out is None else out.unionByName(part)
    return out


def enriched_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Papers without a year or citations, filled from other sources' records of the same arXiv
    id, DOI or title."""
    blank = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    ids = [blank("arxiv_id").alias("arxiv"), blank("doi").alias("doi"), F.nullif(T.normal_title(F.coalesce("title", F.lit(""))), F.lit("")).alias("title")]
    p = papers(spark, folder, "arxiv_id", "doi", "year", "citation_count").select("paper_key", *ids, F.when(F.col("year") % 2 == 0, F.col("year")).alias("year"), F.when(F.col("citation_count") > 9, F.col("citation_count")).alias("citation_count"))
    r = read_table(spark, folder, "papers").where("year IS NOT NULL AND citation_count IS NOT NULL").select(*ids, "year", "citation_count")
    return store.enriched(p, r, ["year", "citation_count"]).select("paper_key", F.col("how").cast("long").alias("how"), "year", "citation_count")


def section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of 120 tokens that stay within the sections of each paper."""
    c = read_table(spark, folder, "chunks").where("paper_id IS NOT NULL").select(key_of("paper_id").alias("paper_key"), "chunk_id", "section", "text").where("paper_key IS NOT NULL").distinct()
    w = chunking.section_windows(c, "paper_key", "chunk_id", "section", "text", 120, 20)
    return w.select(F.col("paper").alias("paper_key"), "chunk", "section", F.size("pages").cast("long").alias("pages"), "token_start", "token_end", F.md5(F.col("text").cast("binary")).alias("digest"))


_NAMES = f"""{N}, lab AS (
  SELECT DISTINCT lower(trim(paper_id)) AS paper_key, CASE WHEN chunk_id % 2 = 1 THEN 'table' ELSE 'figure' END AS env,
    CASE WHEN chunk_id % 2 = 1 THEN 'tab:' ELSE 'fig:' END || chunk_id AS name
  FROM chunks WHERE trim(paper_id) <> '' AND chunk_id IS NOT NULL
), ref AS (
  SELECT DISTINCT lower(trim(paper_id)) AS paper_key, coalesce(CASE WHEN source_chunk % 2 = 1 THEN 'tab:' ELSE 'fig:' END || source_chunk, 'eq:1') AS name
  FROM n WHERE trim(paper_id) <> ''
)"""
_LEDGER = """led AS (
  SELECT lower(trim(paper_id)) AS paper_key, max(added_at) AS last_seen, count(*) AS times_seen, max(influential_citation_count) AS best_score,
    max(citation_count) AS citations, count(removed_at) AS gone
  FROM papers WHERE trim(paper_id) <> '' GROUP BY 1
), led2 AS (
  SELECT *, CASE WHEN paper_key IN (SELECT lower(trim(paper_id)) FROM chunks WHERE paper_id IS NOT NULL) THEN 'downloaded' WHEN gone > 0 THEN 'removed' ELSE 'new' END AS status FROM led
)"""
_EXPECTED = f"""f AS (SELECT * FROM nugget_feedback WHERE trim(query) <> ''),
fq AS (SELECT feedback_id AS query_id, query, coalesce(lower(mode), '(none)') AS mode FROM f WHERE feedback_id % 50 = 0),
{{bm}},
ex AS (SELECT DISTINCT query_id, lower(trim(paper_id)) AS item FROM fq JOIN f USING (query) WHERE rating = 1 AND trim(paper_id) <> ''),
got AS (SELECT DISTINCT query_id, lower(trim(paper_id)) AS item FROM bm JOIN nuggets x ON x.row_id = bm.id WHERE trim(paper_id) <> ''),
er AS (SELECT ex.query_id, count(*) AS expected, count(got.item) AS found FROM ex LEFT JOIN got ON got.query_id = ex.query_id AND got.item = ex.item GROUP BY 1)"""
_EXPECTED = _EXPECTED.format(bm=_bm25_sql("SELECT query_id, query FROM fq", "nuggets", "row_id", 20, "or").strip())
_ARX = "nullif(lower(trim(arxiv_id)), '')"
_DOI = "nullif(lower(trim(doi)), '')"
_TIT = "nullif(trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9\\s\\-]', '', 'g'), '\\s+', ' ', 'g')), '')"

SQL = {
    "cross_references": f"""WITH {_NAMES}
SELECT coalesce(lab.paper_key, ref.paper_key) AS paper_key, CASE WHEN lab.name IS NULL THEN 'broken_ref' ELSE 'unused_label' END AS issue,
  coalesce(lab.name, ref.name) AS name
FROM lab FULL JOIN ref ON lab.paper_key = ref.paper_key AND lab.name = ref.name WHERE lab.name IS NULL OR ref.name IS NULL""",
    "figure_discussion": f"""WITH {_NAMES}, a AS (
  SELECT lab.paper_key, count(*) FILTER (env = 'figure') AS figures, count(*) FILTER (env = 'table') AS tables, count(*) FILTER (ref.name IS NULL) AS not_referenced
  FROM lab LEFT JOIN ref ON lab.paper_key = ref.paper_key AND lab.name = ref.name GROUP BY 1
), b AS (
  SELECT ref.paper_key, count(*) AS broken_refs FROM ref LEFT JOIN lab ON lab.paper_key = ref.paper_key AND lab.name = ref.name
  WHERE lab.name IS NULL AND ref.name <> 'eq:1' GROUP BY 1
)
SELECT coalesce(a.paper_key, b.paper_key) AS paper_key, coalesce(figures, 0) AS figures, coalesce(tables, 0) AS tables,
  coalesce(not_referenced, 0) AS not_referenced, coalesce(broken_refs, 0) AS broken_refs FROM a FULL JOIN b ON a.paper_key = b.paper_key""",
    "glossary_use": f"""WITH {N}, u AS (
  SELECT coalesce(regexp_replace(lower(type), '\\W', '', 'g'), 'none') AS term, count(DISTINCT lower(trim(paper_id))) AS papers FROM n WHERE trim(paper_id) <> '' GROUP BY 1
), g AS (SELECT unnest([{", ".join(f"'{k}'" for k in GLOSSARY_KEYS)}]) AS term)
SELECT coalesce(u.term, g.term) AS term, CASE WHEN g.term IS NULL THEN 'undefined' WHEN u.term IS NULL THEN 'unused' ELSE 'used' END AS status,
  coalesce(papers, 0) AS papers FROM u FULL JOIN g ON u.term = g.term WHERE coalesce(u.term, g.term) <> ''""",
    "expected_recall": f"""WITH {_EXPECTED}
SELECT mode, count(*) AS queries, {half_up_sql("avg(found / expected)")} AS mean_recall, count(*) FILTER (found = expected) AS passed,
  count(*) FILTER (found = 0) AS zero FROM er JOIN fq USING (query_id) GROUP BY 1""",
    "expected_missing": f"""WITH {_EXPECTED}
SELECT query_id, item AS paper_key FROM (SELECT query_id, item FROM ex EXCEPT SELECT query_id, item FROM got)""",
    "citations_for_text": f"""WITH dd AS (SELECT doc_id, {_SENT} AS s FROM documents WHERE text IS NOT NULL AND doc_id % 50 = 0),
sen AS (SELECT doc_id || ':' || (i - 1) AS query_id, doc_id, CAST(i - 1 AS BIGINT) AS sentence_no, s[i] AS query FROM dd, unnest(range(1, len(s) + 1)) AS r(i)
  WHERE len(regexp_extract_all(s[i], '\\S+')) >= 5),
{_bm25_sql("SELECT query_id, query FROM sen", "nuggets", "row_id", 5, "or").strip()}
SELECT doc_id, sentence_no, rank, nugget_id FROM bm JOIN sen USING (query_id) JOIN nuggets x ON x.row_id = bm.id""",
    "find_papers_any": f"""WITH {P} SELECT paper_key, year FROM p
WHERE (coalesce(title ILIKE '%grid%', false) OR coalesce(authors ILIKE '%grid%', false) OR coalesce(paper_id ILIKE '%grid%', false)) AND year >= 2016""",
    "preferred_nuggets": f"""WITH {N}, k AS (
  SELECT nugget_id, lower(trim(paper_id)) AS paper_key, flagged, ingested_at >= TIMESTAMP '{SPLIT_AT}' AS later,
    CASE WHEN overall_score BETWEEN 1 AND 5 AND NOT isnan(overall_score) THEN overall_score END AS score FROM n WHERE trim(paper_id) <> ''
), u AS (SELECT * FROM k WHERE flagged = 0 AND later),
r AS (
  SELECT paper_key, CASE WHEN score <= 2 THEN 3.0 ELSE score END AS score FROM k WHERE NOT later
  UNION ALL SELECT paper_key, score FROM k WHERE later AND coalesce(flagged, 1) <> 0 AND paper_key IN (SELECT paper_key FROM k WHERE NOT later)
), x AS (SELECT paper_key, score FROM u UNION ALL SELECT paper_key, score FROM r WHERE paper_key NOT IN (SELECT paper_key FROM u))
SELECT paper_key, count(*) AS nuggets, {half_up_sql("avg(score)", 3)} AS mean_score FROM x GROUP BY 1""",
    "manifest_merge": f"""WITH {P}, o AS (
  SELECT lower(trim(paper_id)) AS paper_key, min({{'added_at': added_at, 'title': title, 'abstract': abstract, 'doi': doi, 'year': year}}) AS r
  FROM (SELECT * FROM papers WHERE trim(paper_id) <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(paper_id)) ORDER BY added_at NULLS FIRST, title NULLS FIRST, abstract NULLS FIRST, doi NULLS FIRST, year NULLS FIRST) = 1) GROUP BY 1
)
SELECT p.paper_key, md5(coalesce(CASE WHEN length(trim(p.abstract, ' ')) >= 50 THEN p.abstract END, o.r.abstract, p.abstract, '')) AS abstract,
  coalesce(CASE WHEN length(trim(p.doi, ' ')) >= 1 THEN p.doi END, o.r.doi, p.doi) AS doi, coalesce(p.year, o.r.year) AS year
FROM p JOIN o ON o.paper_key = p.paper_key""",
    "ledger_status": f"WITH {_LEDGER} SELECT status, count(*) AS entries, CAST(sum(times_seen) AS BIGINT) AS sightings FROM led2 GROUP BY 1",
    "ledger_top": f"""WITH {_LEDGER}, e AS (SELECT * FROM led2 WHERE best_score >= 2)
{" UNION ALL ".join(f"(SELECT '{by}' AS sorted_by, row_number() OVER (ORDER BY {c} DESC NULLS LAST, paper_key) AS rank, paper_key FROM e QUALIFY rank <= 20)" for by, c in (("score", "best_score"), ("citations", "citations"), ("recent", "last_seen"), ("seen", "times_seen")))}""",
    "enriched_papers": f"""WITH {P}, x AS (
  SELECT paper_key, {_ARX} AS arxiv, {_DOI} AS doi, {_TIT} AS title, CASE WHEN year % 2 = 0 THEN year END AS year, CASE WHEN citation_count > 9 THEN citation_count END AS cc FROM p
), r AS (SELECT {_ARX} AS arxiv, {_DOI} AS doi, {_TIT} AS title, year, citation_count AS cc FROM papers WHERE year IS NOT NULL AND citation_count IS NOT NULL),
a AS (SELECT arxiv, year, cc FROM r WHERE arxiv IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arxiv ORDER BY year, cc) = 1),
d AS (SELECT doi, year, cc FROM r WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doi ORDER BY year, cc) = 1),
t AS (SELECT title, year, cc FROM r WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY year, cc) = 1)
SELECT paper_key, CASE WHEN a.year IS NOT NULL THEN 1 WHEN d.year IS NOT NULL THEN 2 WHEN t.year IS NOT NULL THEN 3 END AS how,
  coalesce(x.year, a.year, d.year, t.year) AS year, coalesce(x.cc, a.cc, d.cc, t.cc) AS citation_count
FROM x LEFT JOIN a ON a.arxiv = x.arxiv LEFT JOIN d ON d.doi = x.doi LEFT JOIN t ON t.title = x.title""",
}

QUERIES = {
    f.__name__: f
    for f in (
        cross_references, figure_discussion, glossary_use, expected_recall, expected_missing, citations_for_text, find_papers_any,
        preferred_nuggets, manifest_merge, ledger_status, ledger_top, enriched_papers, section_chunks,
    )
}
