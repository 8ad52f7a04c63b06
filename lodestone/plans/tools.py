"""Analytics tools over retrieval results, papers and manuscripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators.vectors import nearest, nearest_within
from lodestone.plans.base import N, P, half_up_sql, nuggets, papers
from lodestone.session import half_up, key_of, read_table
from lodestone.sources.bibliography import bib_entries


def _hits(spark: SparkSession, folder: str, vector: int, k: int, where: str = "true") -> DataFrame:
    """The k nearest nuggets to a stored vector: vec_id, nugget_id, paper_key, type, question, distance, rank."""
    e = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    n = read_table(spark, folder, "nuggets").select(
        "row_id", "nugget_id", key_of("paper_id").alias("paper_key"), F.lower("type").alias("type"), "question"
    )
    v = e.join(n.where(where).select(F.col("row_id").alias("vec_id")), "vec_id", "left_semi")
    q = e.where(F.col("vec_id") == vector).withColumnRenamed("vec_id", "query_id")
    return nearest(q, v, k).join(n, F.col("vec_id") == F.col("row_id")).drop("query_id", "row_id")


def suggest_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Papers to read on a topic: near, often hit, recent and cited; the best 10."""
    g = _hits(spark, folder, 7, 60).where("paper_key IS NOT NULL").groupBy("paper_key").agg(F.min("distance").alias("d"), F.count(F.lit(1)).alias("hits"))
    p = papers(spark, folder, "year", "citation_count").select("paper_key", "title", "year", F.coalesce("citation_count", F.lit(0)).alias("cc"))
    recency = F.greatest(F.coalesce("year", F.lit(2020)) - 2015, F.lit(0)) / 10
    score = F.col("d") * 0.5 - F.col("hits") * 0.1 - recency * 0.2 - F.least(F.col("cc") / 100, F.lit(1.0)) * 0.2
    s = g.join(p, "paper_key").select("paper_key", "title", "hits", half_up(F.col("d")).alias("best_distance"), half_up(score).alias("score"))
    return s.orderBy("score", "paper_key").limit(10)


def gap_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """Uncited papers near a topic with their nearest nugget; papers with a link are cited."""
    cited = read_table(spark, folder, "code_links").select(key_of("paper_id").alias("paper_key")).where("paper_key IS NOT NULL").distinct()
    h = _hits(spark, folder, 11, 50).where("paper_key IS NOT NULL").join(cited, "paper_key", "left_anti")
    g = h.groupBy("paper_key").agg(F.min(F.struct("distance", "vec_id", "question")).alias("b"), F.count(F.lit(1)).alias("hits"))
    out = g.select("paper_key", "hits", half_up(F.col("b.distance")).alias("best_distance"), F.col("b.question").alias("best_question"))
    return out.orderBy("best_distance", "paper_key").limit(10)


def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of near nuggets of different papers, in the order of their ranks; the first 10."""
    h = _hits(spark, folder, 13, 20).where("distance < 1.0 AND paper_key IS NOT NULL")
    a = h.select(F.col("rank").alias("rank_a"), F.col("nugget_id").alias("nugget_a"), F.col("paper_key").alias("pa"))
    b = h.select(F.col("rank").alias("rank_b"), F.col("nugget_id").alias("nugget_b"), F.col("paper_key").alias("pb"))
    pairs = a.join(b, (F.col("rank_a") < F.col("rank_b")) & (F.col("pa") != F.col("pb")))  # at most 20 rows a side
    return pairs.orderBy("rank_a", "rank_b").limit(10).select("rank_a", "rank_b", "nugget_a", "nugget_b")


BAND = 0.05


def consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Bands of distance among the 50 nearest nuggets, each begun by the nearest one outside
    the band before it, labelled by how many papers agree."""
    h = _hits(spark, folder, 17, 50).select("rank", "distance", "paper_key")
    # The fold runs over at most 50 rows, in the JVM.
    rows = h.agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "paper_key"))).alias("r"))
    start = F.struct(F.lit(-9.0).alias("anchor"), F.lit(0).alias("band"), F.array().cast("array<struct<band:int,paper_key:string>>").alias("out"))

    def step(acc, x):
        new = x["distance"] - acc["anchor"] >= BAND
        band = acc["band"] + F.when(new, 1).otherwise(0)
        return F.struct(
            F.when(new, x["distance"]).otherwise(acc["anchor"]).alias("anchor"),
            band.alias("band"),
            F.concat(acc["out"], F.array(F.struct(band.alias("band"), x["paper_key"].alias("paper_key")))).alias("out"),
        )

    bands = rows.select(F.explode(F.aggregate("r", start, step, lambda a: a["out"])).alias("o")).select("o.*")
    g = bands.groupBy("band").agg(F.countDistinct("paper_key").alias("papers"), F.count(F.lit(1)).alias("nuggets"))
    label = F.when(F.col("papers") >= 3, "consensus").when(F.col("papers") == 2, "moderate").otherwise("single_source")
    return g.withColumn("label", label)


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    """The papers of the 60 nearest nuggets by year, each paper once."""
    h = _hits(spark, folder, 19, 60).where("paper_key IS NOT NULL").groupBy("paper_key").agg(F.min("distance").alias("d"))
    y = h.join(papers(spark, folder, "year").where("year IS NOT NULL").select("paper_key", "year"), "paper_key")
    return y.groupBy("year").agg(F.count(F.lit(1)).alias("papers"), F.min(F.struct("d", "paper_key")).alias("b")).select("year", "papers", F.col("b.paper_key").alias("nearest"))


def compare_papers(spark: SparkSession, folder: str) -> DataFrame:
    """The two papers with most nuggets side by side: the best 5 of each type."""
    n = nuggets(spark, folder, "paper_id", "type", "overall_score").withColumn("paper_key", key_of("paper_id")).where("paper_key IS NOT NULL AND type IS NOT NULL")
    two = n.groupBy("paper_key").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "paper_key").limit(2)
    two = two.withColumn("side", F.row_number().over(Window.orderBy(F.col("c").desc(), "paper_key"))).select("paper_key", "side")  # two rows
    score = F.when(F.col("overall_score").between(1, 5), F.col("overall_score")).otherwise(0.0)
    order = Window.partitionBy("side", "kind").orderBy(F.col("score").desc(), "nugget_id")
    r = n.join(F.broadcast(two), "paper_key").select("side", F.lower("type").alias("kind"), "nugget_id", score.alias("score"))
    r = r.withColumn("k", F.row_number().over(order)).where("k <= 5")
    a = r.where("side = 1").select("kind", "k", F.col("nugget_id").alias("first"))
    b = r.where("side = 2").select("kind", "k", F.col("nugget_id").alias("second"))
    return a.join(b, ["kind", "k"], "full_outer").select("kind", "k", "first", "second")


def counter_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Limitations, comparisons and claims near any of four phrasings, nearest sighting once."""
    e = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    n = read_table(spark, folder, "nuggets").where(F.lower("type").isin("limitation", "comparison", "claim")).select(F.col("row_id").alias("vec_id"), "nugget_id")
    q = e.where("vec_id IN (21, 22, 23, 24)").withColumnRenamed("vec_id", "query_id")
    h = nearest(q, e.join(n.select("vec_id"), "vec_id", "left_semi"), 10)
    best = h.groupBy("vec_id").agg(F.min("distance").alias("d")).orderBy("d", "vec_id").limit(10)
    return best.join(n, "vec_id").select("nugget_id", half_up(F.col("d")).alias("distance"))


def claim_support(spark: SparkSession, folder: str) -> DataFrame:
    """For the paper of every 50th vector: whether one of its nuggets supports the vector's
    claim (distance under 0.8), looked for in that paper alone."""
    e = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    n = read_table(spark, folder, "nuggets").select(F.col("row_id").alias("vec_id"), key_of("paper_id").alias("paper_key")).where("paper_key IS NOT NULL")
    v = e.join(n, "vec_id")
    q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "claim")
    g = nearest_within(q, v, query_id="claim", vector_id="vec_id", group="paper_key")
    d = F.col("distance")
    return g.select(F.col("query_id").alias("claim"), "compared", half_up(d).alias("best_distance"), (d < 0.8).alias("supported"))


def reference_status(spark: SparkSession, folder: str) -> DataFrame:
    """Paper keys used by links and by ratings: in both, in one of them, known or missing."""
    links = read_table(spark, folder, "code_links").select(key_of("paper_id").alias("k")).where("k IS NOT NULL").distinct().withColumn("linked", F.lit(True))
    rated = read_table(spark, folder, "nugget_feedback").select(key_of("paper_id").alias("k")).where("k IS NOT NULL").distinct().withColumn("rated", F.lit(True))
    known = papers(spark, folder).select(F.col("paper_key").alias("k"), F.lit(True).alias("known"))
    j = links.join(rated, "k", "full_outer").join(known, "k", "left")
    side = F.when(F.col("linked") & F.col("rated"), "both").when(F.col("linked"), "links").otherwise("ratings")
    return j.groupBy(side.alias("used_by"), F.when(F.col("known"), "found").otherwise("missing").alias("status")).agg(F.count(F.lit(1)).alias("keys"))


# Words that do not belong into a kind of chapter, by the rule they break.
CHAPTER_WORDS = {
    ("introduction", "no_architecture_in_intro"): (
        "encoder", "decoder", "layer", "backbone", "module", "convolution", "attention head", "feature pyramid", "architecture"),
    ("introduction", "no_experiments_in_intro"): (
        "dataset", "training set", "test set", "epoch", "batch size", "learning rate", "hyperparameter", "ablation"),
    ("background", "no_opinions_in_background"): (
        "better", "superior", "outperform", "advantage", "disadvantage", "best", "worst", "prefer", "recommend", "promising", "impressive"),
    ("model", "no_experiments_in_model"): (
        "training", "test set", "validation set", "epoch", "batch size", "learning rate", "loss function", "optimizer"),
}


def chapter_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """The first line of each document with each word that an introduction, a background or a
    model chapter should not have, and the rule it breaks."""
    d = read_table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    words = F.regexp_extract_all(F.lower("line"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    flat = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    every = sorted({w for ws in CHAPTER_WORDS.values() for w in ws}, key=lambda w: (-len(w), w))
    # One pass finds all words; those that others hold ("test set") are looked for behind them too.
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(flat, F.lit(f"(?<= )({'|'.join(g)})(?= )"), 1) for g in ([w for w in every if " " in w], [w for w in every if " " not in w])])))
    hits = d.where(~F.trim("line").startswith("%")).select("doc_id", "i", F.explode(found).alias("word"))
    first = hits.groupBy("doc_id", "word").agg((F.min("i") + 1).cast("long").alias("line_no"))
    rules = F.create_map(*[x for w in every for x in (F.lit(w), F.array(*[F.struct(F.lit(c).alias("chapter"), F.lit(r).alias("rule")) for (c, r), ws in CHAPTER_WORDS.items() if w in ws]))])
    return first.select("doc_id", F.explode(rules[F.col("word")]).alias("r"), "word", "line_no").select("doc_id", "r.chapter", "r.rule", "word", "line_no")


# Vague openings, words of performance, hedges, signs of a comparison.
_VAGUE = r"(?i)^\s*(This|These|It|That)\s+(is|are|was|were|has|have|can|could|will|would|show)"
_PERFORMANCE = ("outperform", "superior", "better", "best", "faster", "slower", "higher", "lower", "achieve", "improve", "sota")
_HEDGE = ("may", "might", "could", "potentially", "suggests", "appears", "seems")
_COMPARED = r"(?i)(compared to|versus|vs\.|relative to|increase|decrease|improvement)"


#: Keys and short forms of the glossary that rule 13 is checked against.
GLOSSARY = {"gigabyte": "GB", "figure": "Fig", "frames": "fps", "decibel": "dB"}


def style_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the documents that break writing rules, by rule: 1 first person, 2 claim
    without citation or hedge, 9 vague opening, 10 percentage without comparison, 12 display
    formula in brackets, 13 a glossary's term without its command (a line per term and document)."""
    d = read_table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", F.trim("l").alias("l"))
    d = d.where("l <> '' AND NOT startswith(l, '%')")
    words = F.regexp_extract_all(F.lower("l"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    any_of = lambda names: F.exists(words, lambda w: w.isin(*names))
    cited = F.col("l").contains("\\cite")
    rules = {
        1: any_of(("i", "we", "our", "us", "my")),
        2: (any_of(_PERFORMANCE) | F.lower("l").contains("state-of-the-art")) & ~cited & ~any_of(_HEDGE),
        9: F.col("l").rlike(_VAGUE),
        10: F.col("l").rlike(r"\d+\.?\d*\s*%") & ~cited & ~F.col("l").rlike(_COMPARED),
        12: F.col("l").contains("\\[") & ~F.col("l").contains("\\begin{"),
    }
    r = d.select(F.explode(F.filter(F.array(*[F.when(c, k) for k, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    spelled = F.regexp_extract_all("l", F.lit(r"[\p{L}\p{N}_]+"), 0)
    bare = lambda key, short: F.array_contains(spelled, short) & ~F.col("l").contains(f"\\gls{{{key}}}") & ~F.col("l").contains(f"\\acrshort{{{key}}}")
    terms = F.filter(F.array(*[F.when(bare(k, s), F.lit(k)) for k, s in GLOSSARY.items()]), lambda x: x.isNotNull())
    raw = d.select("doc_id", F.explode(terms).alias("term")).distinct().select(F.lit(13).alias("rule"))
    return r.unionByName(raw).groupBy("rule").agg(F.count(F.lit(1)).alias("lines"))


def bibtex_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Surname_Year:slug keys of the papers, repeated ones with a letter."""
    json = F.from_json("authors", "array<string>")
    first = F.coalesce(F.when(F.col("authors").startswith("["), F.get(json, F.lit(0))).otherwise(F.get(F.split("authors", ";"), F.lit(0))), F.lit("unknown"))
    surname = F.coalesce(F.nullif(F.regexp_extract(F.trim(first), r"([A-Za-z]+)$", 1), F.lit("")), F.lit("Unknown"))
    stop = F.array(*[F.lit(w) for w in ("the", "a", "an", "of", "for", "and", "in", "on", "with", "to", "from", "by", "via", "using")])
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z0-9]+"), 0), lambda w: ~F.array_contains(stop, w))
    base = F.concat(surname, F.lit("_"), F.coalesce(F.col("year").cast("string"), F.lit("nd")), F.lit(":"), F.array_join(F.slice(words, 1, 4), "-"))
    b = papers(spark, folder, "authors", "year").select("paper_key", base.alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("paper_key"))
    return b.withColumn("k", k).select("paper_key", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.char(F.col("k") + 95))).alias("cite_key"))


def bibtex_health(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of the bibliography written from the papers, parsed again, by kind."""
    clean = lambda c: F.regexp_replace(F.col(c), r"[{}\\\\\"]", "")
    field = lambda name, c: F.when(c.isNotNull() & (F.trim(c) != ""), F.concat(F.lit(f"  {name} = {{"), c, F.lit("},\n"))).otherwise("")
    entry = F.concat(
        F.lit("@article{"), F.md5(F.col("paper_key").cast("binary")), F.lit(",\n"), field("title", clean("title")), field("author", clean("authors")),
        field("year", F.col("year").cast("string")), field("doi", clean("doi")), F.lit("}\n"),
    )
    p = papers(spark, folder, "authors", "year", "doi").select(F.col("paper_key").alias("id"), entry.alias("bib"))
    e = bib_entries(p, "id", "bib")
    have = F.map_keys("fields")
    missing = F.array_except(F.array(*[F.lit(x) for x in ("author", "title", "year")]), have)
    issues = F.concat(
        F.transform(missing, lambda m: F.concat(F.lit("missing_"), m)),
        F.when(~F.array_contains(have, "doi") & ~F.array_contains(have, "url"), F.array(F.lit("no_doi_or_url"))).otherwise(F.array().cast("array<string>")),
        F.when(~F.coalesce(F.element_at("fields", "year").try_cast("int").between(1950, 2027), F.lit(True)), F.array(F.lit("year"))).otherwise(F.array().cast("array<string>")),
    )
    return e.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("entries"))


_E = "1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
_PK = "CASE WHEN trim(x.paper_id) <> '' THEN lower(trim(x.paper_id)) END"


def _hits_sql(vector: int, k: int, where: str = "true") -> str:
    return f"""h AS (SELECT e.vec_id, x.nugget_id, {_PK} AS paper_key, x.question, {_E} AS distance,
  row_number() OVER (ORDER BY {_E}, e.vec_id) AS rank
  FROM embeddings q, embeddings e JOIN nuggets x ON x.row_id = e.vec_id WHERE q.vec_id = {vector} AND {where} QUALIFY rank <= {k})"""


_LINE = "l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), unnest(range(1, len(lines) + 1)) AS r(i))"
_TOK = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"
_STOPS = "['the','a','an','of','for','and','in','on','with','to','from','by','via','using']"

SQL = {
    "suggest_coverage": f"""WITH {P}, {_hits_sql(7, 60)}, g AS (SELECT paper_key, min(distance) AS d, count(*) AS hits FROM h WHERE paper_key IS NOT NULL GROUP BY 1)
SELECT g.paper_key, title, hits, {half_up_sql('d')} AS best_distance, {half_up_sql('''d * 0.5::DOUBLE - hits * 0.1::DOUBLE - greatest(coalesce(year, 2020) - 2015, 0) / 10::DOUBLE * 0.2
  - least(coalesce(citation_count, 0) / 100::DOUBLE, 1.0) * 0.2''')} AS score FROM g JOIN p ON p.paper_key = g.paper_key ORDER BY score, g.paper_key LIMIT 10""",
    "gap_analysis": f"""WITH {_hits_sql(11, 50)}, g AS (SELECT paper_key, count(*) AS hits, min(distance) AS d, arg_min(question, (distance, vec_id)) AS q FROM h
  WHERE paper_key IS NOT NULL AND paper_key NOT IN (SELECT lower(trim(paper_id)) FROM code_links WHERE trim(paper_id) <> '') GROUP BY 1)
SELECT paper_key, hits, {half_up_sql('d')} AS best_distance, q AS best_question FROM g ORDER BY best_distance, paper_key LIMIT 10""",
    "conflicts": f"""WITH {_hits_sql(13, 20)}, k AS (SELECT * FROM h WHERE distance < 1.0 AND paper_key IS NOT NULL)
SELECT a.rank AS rank_a, b.rank AS rank_b, a.nugget_id AS nugget_a, b.nugget_id AS nugget_b FROM k a JOIN k b ON a.rank < b.rank AND a.paper_key <> b.paper_key
ORDER BY 1, 2 LIMIT 10""",
    "consensus": f"""WITH RECURSIVE {_hits_sql(17, 50)}, r(band, anchor) AS (
  SELECT 1, min(distance) FROM h
  UNION ALL SELECT band + 1, (SELECT min(distance) FROM h WHERE distance - anchor >= {BAND}) FROM r WHERE EXISTS (SELECT 1 FROM h WHERE distance - anchor >= {BAND})
), b AS (SELECT h.*, (SELECT max(band) FROM r WHERE r.anchor <= h.distance) AS band FROM h),
g AS (SELECT band, count(DISTINCT paper_key) AS papers, count(*) AS nuggets FROM b GROUP BY 1)
SELECT CAST(band AS INTEGER) AS band, papers, nuggets, CASE WHEN papers >= 3 THEN 'consensus' WHEN papers = 2 THEN 'moderate' ELSE 'single_source' END AS label FROM g""",
    "timeline": f"""WITH {P}, {_hits_sql(19, 60)}, g AS (SELECT paper_key, min(distance) AS d FROM h WHERE paper_key IS NOT NULL GROUP BY 1)
SELECT year, count(*) AS papers, arg_min(g.paper_key, (d, g.paper_key)) AS nearest FROM g JOIN p ON p.paper_key = g.paper_key WHERE year IS NOT NULL GROUP BY 1""",
    "compare_papers": f"""WITH {N}, x AS (SELECT lower(trim(paper_id)) AS paper_key, lower(type) AS kind, nugget_id,
  CASE WHEN overall_score BETWEEN 1 AND 5 THEN overall_score ELSE 0 END AS score FROM n WHERE trim(paper_id) <> '' AND type IS NOT NULL),
t AS (SELECT paper_key, row_number() OVER (ORDER BY count(*) DESC, paper_key) AS side FROM x GROUP BY 1 QUALIFY side <= 2),
r AS (SELECT side, kind, nugget_id, row_number() OVER (PARTITION BY side, kind ORDER BY score DESC, nugget_id) AS k FROM x JOIN t USING (paper_key) QUALIFY k <= 5)
SELECT coalesce(a.kind, b.kind) AS kind, CAST(coalesce(a.k, b.k) AS INTEGER) AS k, a.nugget_id AS first, b.nugget_id AS second
FROM (SELECT * FROM r WHERE side = 1) a FULL JOIN (SELECT * FROM r WHERE side = 2) b ON a.kind = b.kind AND a.k = b.k""",
    "counter_evidence": f"""WITH h AS (SELECT e.vec_id, x.nugget_id, {_E} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_E}, e.vec_id) AS k
  FROM embeddings q, embeddings e JOIN nuggets x ON x.row_id = e.vec_id WHERE q.vec_id IN (21, 22, 23, 24) AND lower(x.type) IN ('limitation', 'comparison', 'claim') QUALIFY k <= 10),
b AS (SELECT vec_id, any_value(nugget_id) AS nugget_id, min(d) AS d FROM h GROUP BY 1 ORDER BY 3, 1 LIMIT 10)
SELECT nugget_id, {half_up_sql('d')} AS distance FROM b""",
    "claim_support": f"""WITH v AS (SELECT e.vec_id, e.embedding, lower(trim(x.paper_id)) AS paper_key FROM embeddings e JOIN nuggets x ON x.row_id = e.vec_id WHERE trim(x.paper_id) <> '')
SELECT q.vec_id AS claim, count(*) AS compared, {half_up_sql(f'min({_E})')} AS best_distance, min({_E}) < 0.8 AS supported
FROM v q JOIN v e ON e.paper_key = q.paper_key AND e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1""",
    "reference_status": f"""WITH {P}, l AS (SELECT DISTINCT lower(trim(paper_id)) AS k FROM code_links WHERE trim(paper_id) <> ''),
r AS (SELECT DISTINCT lower(trim(paper_id)) AS k FROM nugget_feedback WHERE trim(paper_id) <> ''),
j AS (SELECT coalesce(l.k, r.k) AS k, CASE WHEN l.k IS NOT NULL AND r.k IS NOT NULL THEN 'both' WHEN l.k IS NOT NULL THEN 'links' ELSE 'ratings' END AS used_by FROM l FULL JOIN r ON l.k = r.k)
SELECT used_by, CASE WHEN p.paper_key IS NULL THEN 'missing' ELSE 'found' END AS status, count(*) AS keys FROM j LEFT JOIN p ON p.paper_key = j.k GROUP BY 1, 2""",
    "chapter_boundaries": f"""WITH {_LINE}, t AS (SELECT doc_id, i, ' ' || array_to_string({_TOK.format(c='line')}, ' ') || ' ' AS flat FROM l WHERE NOT starts_with(trim(line), '%'))
SELECT doc_id, chapter, rule, word, min(i) AS line_no
FROM t, (VALUES {', '.join(f"('{c}', '{r}', '{w}')" for (c, r), ws in CHAPTER_WORDS.items() for w in ws)}) AS v(chapter, rule, word)
WHERE contains(flat, ' ' || word || ' ') GROUP BY ALL""",
    "style_rules": f"""WITH {_LINE}, t AS (SELECT doc_id, trim(line, ' ') AS l, {_TOK.format(c='line')} AS w FROM l WHERE trim(line, ' ') <> '' AND NOT starts_with(trim(line, ' '), '%'))
SELECT rule, count(*) AS lines FROM (
  SELECT 1 AS rule FROM t WHERE list_has_any(w, ['i', 'we', 'our', 'us', 'my'])
  UNION ALL SELECT 2 FROM t WHERE (list_has_any(w, [{', '.join(f"'{x}'" for x in _PERFORMANCE)}]) OR contains(lower(l), 'state-of-the-art')) AND NOT list_has_any(w, [{', '.join(f"'{x}'" for x in _HEDGE)}]) AND NOT contains(l, '\\cite')
  UNION ALL SELECT 9 FROM t WHERE regexp_matches(l, '{_VAGUE}')
  UNION ALL SELECT 10 FROM t WHERE regexp_matches(l, '\\d+\\.?\\d*\\s*%') AND NOT contains(l, '\\cite') AND NOT regexp_matches(l, '{_COMPARED}')
  UNION ALL SELECT 12 FROM t WHERE contains(l, '\\[') AND NOT contains(l, '\\begin{{')
  UNION ALL SELECT 13 FROM (SELECT DISTINCT doc_id, key FROM t, (VALUES {', '.join(f"('{k}', '{s}')" for k, s in GLOSSARY.items())}) AS g(key, short)
    WHERE list_contains(regexp_extract_all(l, '[\\p{{L}}\\p{{N}}_]+'), short) AND NOT contains(l, '\\gls{{' || key || '}}') AND NOT contains(l, '\\acrshort{{' || key || '}}'))
) GROUP BY 1""",
    "bibtex_keys": f"""WITH {P}, b AS (SELECT paper_key,
  coalesce(nullif(regexp_extract(trim(coalesce(CASE WHEN starts_with(authors, '[') THEN CASE WHEN json_valid(authors) THEN json_extract_string(authors, '$[0]') END
    ELSE split_part(authors, ';', 1) END, 'unknown')), '([A-Za-z]+)$', 1), ''), 'Unknown') || '_' || coalesce(CAST(year AS VARCHAR), 'nd') || ':' ||
  array_to_string(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), lambda w: NOT list_contains({_STOPS}, w))[1:4], '-') AS base FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY paper_key) AS k FROM b)
SELECT paper_key, CASE WHEN k = 1 THEN base ELSE base || '-' || chr(CAST(k + 95 AS INTEGER)) END AS cite_key FROM k""",
    "bibtex_health": f"""WITH {P}, i AS (
  SELECT 'missing_author' AS issue FROM p WHERE authors IS NULL OR trim(regexp_replace(authors, '[{{}}\\\\"]', '', 'g')) = ''
  UNION ALL SELECT 'missing_title' FROM p WHERE title IS NULL OR trim(title) = ''
  UNION ALL SELECT 'missing_year' FROM p WHERE year IS NULL
  UNION ALL SELECT 'no_doi_or_url' FROM p WHERE doi IS NULL OR trim(doi) = ''
  UNION ALL SELECT 'year' FROM p WHERE year NOT BETWEEN 1950 AND 2027)
SELECT issue, count(*) AS entries FROM i GROUP BY 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        suggest_coverage, gap_analysis, conflicts, consensus, timeline, compare_papers, counter_evidence, claim_support,
        reference_status, chapter_boundaries, style_rules, bibtex_keys, bibtex_health,
    )
}
