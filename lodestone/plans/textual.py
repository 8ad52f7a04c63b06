"""Text analytics over whole tables of documents, nuggets and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.plans.base import N, P, half_up_sql, nuggets, papers
from lodestone.session import half_up, key_of, read_table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", "text", "source").where("text IS NOT NULL")


def word_paragraph_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", T.whitespace_words(F.col("text")).alias("words"), T.paragraphs(F.col("text")).alias("paragraphs"))


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """All sentences of the documents, numbered from 1."""
    d = _docs(spark, folder).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return d.select("doc_id", (F.col("pos") + 1).alias("sentence_no"), "sentence")


def flesch_kincaid(spark: SparkSession, folder: str) -> DataFrame:
    """Readability of each document."""
    d = _docs(spark, folder).select(
        "doc_id",
        F.greatest(T.whitespace_words(F.col("text")), F.lit(1)).alias("words"),
        F.greatest(F.size(T.sentences(F.col("text"))), F.lit(1)).cast("long").alias("sentences"),
        T.syllables(F.col("text")).alias("syllables"),
    )
    per_sentence, per_word = F.col("words") / F.col("sentences"), F.col("syllables") / F.col("words")
    return d.select(
        "doc_id", "words", "sentences", "syllables",
        half_up(0.39 * per_sentence + 11.8 * per_word - 15.59, 1).alias("grade"),
        half_up(206.835 - 1.015 * per_sentence - 84.6 * per_word, 1).alias("ease"),
    )


def ai_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of machine-written text per source, per 1000 words."""
    counts = [T.matches_of(F.col("text"), p).alias(c) for c, p in T.AI_PATTERNS.items()]
    d = _docs(spark, folder).select(F.coalesce("source", F.lit("(none)")).alias("source"), T.whitespace_words(F.col("text")).alias("words"), *counts)
    sums = [F.sum(c).cast("long").alias(c) for c in T.AI_PATTERNS]
    g = d.groupBy("source").agg(F.sum("words").cast("long").alias("words"), *sums)
    total = sum((F.col(c) for c in T.AI_PATTERNS), F.lit(0))
    return g.withColumn("density", half_up(total * 1000 / F.greatest("words", F.lit(1)), 2))


_PRONOUNS = ("i", "we", "our", "us", "my")


def first_person(spark: SparkSession, folder: str) -> DataFrame:
    """First-person pronouns per document, outside comment and formula lines."""
    d = _docs(spark, folder).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    d = d.where(~F.trim("line").rlike(r"^(?:%|\$|\\\[)"))
    words = F.regexp_extract_all(F.lower("line"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return d.select("doc_id", F.size(F.filter(words, lambda w: w.isin(*_PRONOUNS))).cast("long").alias("n")).groupBy("doc_id").agg(F.sum("n").cast("long").alias("pronouns")).where("pronouns > 0")


def hedging(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences per source by strength of claim."""
    d = _docs(spark, folder).select(F.coalesce("source", F.lit("(none)")).alias("source"), F.explode(T.sentences(F.col("text"))).alias("s"))
    low = F.lower("s")
    cited, hedge, claim = low.contains("cite") | F.col("s").contains("["), T.contains_any(low, T.HEDGES), T.contains_any(low, T.CLAIMS)
    kind = F.when(cited, "cited").when(claim & ~hedge, "strong").when(hedge, "hedged").otherwise("neutral")
    per = Window.partitionBy("source")
    g = d.groupBy("source", kind.alias("strength")).agg(F.count(F.lit(1)).alias("sentences"))
    return g.withColumn("percent", half_up(F.col("sentences") * 100 / F.sum("sentences").over(per), 1))


def normalize_title(spark: SparkSession, folder: str) -> DataFrame:
    return papers(spark, folder).where("title IS NOT NULL").select("paper_key", T.normal_title(F.col("title")).alias("normal_title"))


def bigram_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The 40 most frequent pairs of topic words in questions, from 15 occurrences on."""
    words = T.topic_words(F.col("question"), 2)
    b = nuggets(spark, folder, "question").where("question IS NOT NULL").select(F.explode(T.bigrams(words)).alias("term"))
    g = b.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 15")
    return g.orderBy(F.col("n").desc(), "term").limit(40)


def unigram_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 most frequent topic words in questions, from 30 occurrences on."""
    u = nuggets(spark, folder, "question").where("question IS NOT NULL").select(F.explode(T.topic_words(F.col("question"), 3)).alias("term"))
    g = u.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 30")
    return g.orderBy(F.col("n").desc(), "term").limit(20)


#: Mentions from which a name counts. The tables' texts hold few names by form.
ENTITY_LEAST = 3
#: Names of one thing, with those that the tables' texts use.
NAMES_OF_ONE = (*T.SYNONYMS, ("frame rate", "fps"), ("energy per inference", "mJ"), ("hot pixels", "saturated pixels"))


def entity_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Names by form (camel case, acronyms, hyphenated capitals) with at least ENTITY_LEAST mentions."""
    n = nuggets(spark, folder, "question", "answer").select(F.concat_ws("\n", "question", "answer").alias("t"))
    found = F.flatten(F.array(*[F.regexp_extract_all("t", F.lit(p), 0) for p in T.ENTITY_FORMS]))
    e = n.select(F.explode(found).alias("term")).where(~F.upper("term").isin(*T.ENTITY_STOPWORDS))
    return e.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ENTITY_LEAST)


def acronyms(spark: SparkSession, folder: str) -> DataFrame:
    """Capital sequences of the documents that need a definition."""
    a = _docs(spark, folder).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z]{2,}\b"), 0))).alias("acronym"))
    a = a.where(~F.col("acronym").isin(*T.KNOWN_ACRONYMS))
    return a.groupBy("acronym").agg(F.count(F.lit(1)).alias("documents"))


def terminology(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that use several names of one thing."""
    groups = []
    for i, names in enumerate(NAMES_OF_ONE):
        for name in names:
            groups.append(F.struct(F.lit(i).alias("synonyms"), F.lit(name).alias("term"), (F.regexp_count(F.lower("text"), F.lit(name.lower()))).cast("long").alias("n")))
    d = _docs(spark, folder).select("doc_id", F.explode(F.filter(F.array(*groups), lambda g: g["n"] > 0)).alias("g")).select("doc_id", "g.*")
    g = d.groupBy("doc_id", "synonyms").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").cast("long").alias("uses"))
    return g.where("terms > 1")


def section_detect(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the section that their first lines announce."""
    d = _docs(spark, folder).select(F.coalesce(T.section_of_block(F.regexp_replace("text", r"(?m)^#+\s*", "")), F.lit("(none)")).alias("section"))
    return d.groupBy("section").agg(F.count(F.lit(1)).alias("documents"))


def reference_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that look like lists of references."""
    c = read_table(spark, folder, "chunks").where("text IS NOT NULL").select("paper_id", "chunk_id", "text").distinct()
    a, b = T.looks_like_references(F.col("text")), T.numbered_line_share(F.col("text"))
    return c.select("paper_id", "chunk_id", a.alias("dense"), (b > 0.4).alias("numbered")).where("dense OR numbered")


def min_length_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with a question and an answer of at least 10 characters, outside skipped sections."""
    n = nuggets(spark, folder, "question", "answer", "section").where((F.length(F.trim("question")) >= 10) & (F.length(F.trim("answer")) >= 10))
    n = n.where(~F.coalesce(F.lower(F.trim("section")), F.lit("")).isin("references", "acknowledgments", "bibliography"))
    return n.groupBy(F.coalesce("section", F.lit("(none)")).alias("section")).agg(F.count(F.lit(1)).alias("nuggets"))


def document_strings(spark: SparkSession, folder: str) -> DataFrame:
    """The text under which each nugget is indexed."""
    n = nuggets(spark, folder, "question", "answer", "type", "section")
    s = F.format_string("[%s] [%s] Q: %s A: %s", *[F.coalesce(c, F.lit("")) for c in ("type", "section", "question", "answer")])
    return n.select("nugget_id", F.md5(s.cast("binary")).alias("digest"), F.length(s).cast("long").alias("chars"))


def clamped_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings forced into 1..5, 3 where there is none, and the lesser of both."""
    c = lambda x: F.when(x.isNull() | F.isnan(x.cast("double")), 3).otherwise(F.least(F.greatest(F.floor(x).cast("int"), F.lit(1)), F.lit(5)))
    n = nuggets(spark, folder, "thesis_relevance", "overall_score").select(c(F.col("thesis_relevance")).alias("relevance"), c(F.col("overall_score")).alias("overall"))
    return n.groupBy("relevance", "overall", F.least("relevance", "overall").alias("least")).agg(F.count(F.lit(1)).alias("nuggets"))


def citation_density(spark: SparkSession, folder: str) -> DataFrame:
    """Citations per 100 words, by section and overall in one pass."""
    c = read_table(spark, folder, "chunks").where("text IS NOT NULL").select("paper_id", "chunk_id", "text", "section").distinct()
    c = c.select(F.coalesce("section", F.lit("(none)")).alias("section"), T.whitespace_words(F.col("text")).alias("w"), F.regexp_count("text", F.lit(r"\[\d+\]")).cast("long").alias("k"))
    g = c.rollup("section").agg(F.sum("w").cast("long").alias("words"), F.sum("k").cast("long").alias("cites"))
    return g.select(F.coalesce("section", F.lit("(all)")).alias("section"), "words", "cites", half_up(F.col("cites") * 100 / F.col("words"), 3).alias("density"))


def section_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Words per section against the mean of all sections, with flags for odd ones."""
    c = read_table(spark, folder, "chunks").where("text IS NOT NULL").select("paper_id", "chunk_id", "text", "section").distinct()
    g = c.groupBy(F.coalesce("section", F.lit("(none)")).alias("section")).agg(F.sum(T.whitespace_words(F.col("text"))).cast("long").alias("words"))
    mean, dev = g.agg(F.avg("words")).scalar(), g.agg(F.stddev_samp("words")).scalar()
    ratio = F.col("words") / F.col("mean")
    return g.withColumn("mean", mean).withColumn("dev", dev).select(
        "section", "words", half_up(ratio, 3).alias("ratio"), half_up(F.col("dev") / F.col("mean"), 3).alias("variation"),
        ((ratio < 0.25) | (ratio > 3)).alias("odd"),
    )


def author_share(spark: SparkSession, folder: str) -> DataFrame:
    """Papers per author, their share of all, flagged above 15 %. Authors are JSON lists or
    text divided by semicolons."""
    json = F.from_json("authors", "array<string>")
    names = F.when(F.col("authors").startswith("["), F.coalesce(json, F.array().cast("array<string>"))).otherwise(F.split("authors", ";"))
    a = papers(spark, folder, "authors").where("authors IS NOT NULL").select(F.explode(names).alias("author")).select(F.trim("author").alias("author")).where("author <> ''")
    g = a.groupBy("author").agg(F.count(F.lit(1)).alias("papers"))
    share = F.col("papers") * 100 / F.col("total")
    return g.withColumn("total", g.agg(F.sum("papers")).scalar()).select("author", "papers", half_up(share, 2).alias("percent"), (share > 15).alias("dominant"))


def chapter_overview(spark: SparkSession, folder: str) -> DataFrame:
    """Words and citations of the parts between headings, per document."""
    parts = F.split("text", r"(?m)^#+[^\n]*$")
    d = _docs(spark, folder).where(F.col("text").rlike(r"(?m)^#+")).select("doc_id", F.posexplode(parts).alias("part", "body"))
    return d.select("doc_id", "part", T.whitespace_words(F.col("body")).alias("words"), F.regexp_count("body", F.lit(r"\[\d+\]")).cast("long").alias("cites"))


def consecutive_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks in which more than two single citations follow one another."""
    c = read_table(spark, folder, "chunks").where("text IS NOT NULL").select("paper_id", "chunk_id", "text").distinct()
    marks = F.regexp_extract_all("text", F.lit(r"\[\d+(?:,\s*\d+)*\]"), 0)
    single = F.transform(marks, lambda m: ~m.contains(","))
    n = F.size(single)
    pairs = F.zip_with(F.slice(single, 1, F.greatest(n - 1, F.lit(0))), F.slice(single, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a & b)
    out = c.select("paper_id", "chunk_id", F.when(n > 1, F.size(F.filter(pairs, lambda x: x))).otherwise(0).cast("long").alias("runs"))
    return out.where("runs > 2").distinct()


def paper_refs(spark: SparkSession, folder: str) -> DataFrame:
    """What messages refer to, by arXiv number or cite key. The messages are written from the
    ratings: the query, a cite command for the nugget, and the paper's number."""
    f = read_table(spark, folder, "nugget_feedback")
    text = F.concat(
        F.coalesce("query", F.lit("")), F.lit(" \\cite{"), F.coalesce(F.trim("nugget_id"), F.lit("")), F.lit("} of "), F.coalesce("paper_id", F.lit(""))
    )
    r = f.select("feedback_id", F.posexplode(T.paper_references(text)).alias("k", "ref"))
    return r.groupBy("ref").agg(F.count(F.lit(1)).alias("messages"), F.max("k").cast("long").alias("last_place"))


_D = "d AS (SELECT doc_id, text, coalesce(source, '(none)') AS source FROM documents WHERE text IS NOT NULL)"
_WORDS = "len(regexp_extract_all({t}, '\\S+'))"
_STOP = "(" + ", ".join(f"'{w}'" for w in T.TOPIC_STOPWORDS) + ")"
_C = "c AS (SELECT DISTINCT paper_id, chunk_id, text, section FROM chunks WHERE text IS NOT NULL)"


def _ai_sql(pattern: str) -> str:
    # RE2 has no look-ahead; all matches less those that a bracket follows.
    p = pattern.replace(r"(?!\s*\()", "").replace("'", "''")
    count = f"len(regexp_extract_all(text, '(?i){p}'))"
    return f"({count} - len(regexp_extract_all(text, '(?i){p}\\s*\\(')))" if "(?!" in pattern else count


_AI = {c: " + ".join(_ai_sql(x) for x in p) for c, p in T.AI_PATTERNS.items()}
_HEAD = "CASE " + " ".join(f"WHEN regexp_matches(l, '{p}') THEN '{n}'" for p, n in T.SECTION_HEADINGS) + " END"
_BARE = "regexp_replace(regexp_replace({t}, '^[.,;:!?\"''()-]+', ''), '[.,;:!?\"''()-]+$', '')"
_ABBR = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)
# RE2 has no look-behind: ends of sentences are marked first, then split at the mark.
_SENT = (
    "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(?i)\\b(" + _ABBR + ")\\.\\s', '\\1.' || chr(1), 'g'), "
    "'([.!?])\\s+([A-Z\\[])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda s: trim(replace(s, chr(1), ' '), ' ')), lambda s: s <> '')"
)

SQL = {
    "word_paragraph_counts": f"""WITH {_D} SELECT doc_id, {_WORDS.format(t='text')} AS words,
  len(list_filter(string_split_regex(text, '\\n\\s*\\n|\\\\par\\b'), lambda x: regexp_matches(x, '\\S'))) AS paragraphs FROM d""",
    "ai_patterns": f"""WITH {_D}, k AS (SELECT source, {_WORDS.format(t='text')} AS w, {', '.join(f'{e} AS {c}' for c, e in _AI.items())} FROM d)
SELECT source, CAST(sum(w) AS BIGINT) AS words, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _AI)},
  {half_up_sql('sum(' + ' + '.join(_AI) + ') * 1000 / greatest(sum(w), 1)::DOUBLE', 2)} AS density FROM k GROUP BY 1""",
    "first_person": f"""WITH {_D}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
SELECT doc_id, CAST(sum(len(list_filter(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ('i', 'we', 'our', 'us', 'my')))) AS BIGINT) AS pronouns FROM l
WHERE NOT regexp_matches(trim(line), '^(?:%|\\$|\\\\\\[)') GROUP BY 1 HAVING pronouns > 0""",
    "normalize_title": f"""WITH {P} SELECT paper_key,
  trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s\\-]', '', 'g'), '\\s+', ' ', 'g')) AS normal_title FROM p WHERE title IS NOT NULL""",
    "bigram_terms": f"""WITH {N}, w AS (SELECT list_filter(regexp_extract_all(lower(question), '[a-z][a-z\\-]+'), lambda x: x NOT IN {_STOP} AND length(x) > 2) AS w FROM n),
b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS term FROM w)
SELECT term, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 15 ORDER BY 2 DESC, 1 LIMIT 40""",
    "unigram_terms": f"""WITH {N}, w AS (SELECT unnest(list_filter(regexp_extract_all(lower(question), '[a-z][a-z\\-]+'), lambda x: x NOT IN {_STOP} AND length(x) > 3)) AS term FROM n)
SELECT term, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 30 ORDER BY 2 DESC, 1 LIMIT 20""",
    "entity_terms": f"""WITH {N}, t AS (SELECT concat_ws(chr(10), question, answer) AS t FROM n), e AS (
{" UNION ALL ".join(f"SELECT unnest(regexp_extract_all(t, '{p}')) AS term FROM t" for p in T.ENTITY_FORMS)})
SELECT term, count(*) AS n FROM e WHERE upper(term) NOT IN ({", ".join(f"'{w}'" for w in T.ENTITY_STOPWORDS)}) GROUP BY 1 HAVING count(*) >= {ENTITY_LEAST}""",
    "chapter_overview": f"""WITH {_D}, p AS (SELECT doc_id, string_split_regex(text, '(?m)^#+[^\\n]*$') AS b FROM d WHERE regexp_matches(text, '(?m)^#+'))
SELECT doc_id, CAST(i - 1 AS INTEGER) AS part, {_WORDS.format(t='b[i]')} AS words, len(regexp_extract_all(b[i], '\\[\\d+\\]')) AS cites FROM p, unnest(range(1, len(b) + 1)) AS r(i)""",
    "consecutive_citations": f"""WITH {_C}, m AS (SELECT DISTINCT paper_id, chunk_id, list_transform(regexp_extract_all(text, '\\[\\d+(?:,\\s*\\d+)*\\]'), lambda x: NOT contains(x, ',')) AS s FROM c),
r AS (SELECT paper_id, chunk_id, len(list_filter(range(1, len(s)), lambda i: s[i] AND s[i + 1])) AS runs FROM m)
SELECT DISTINCT * FROM r WHERE runs > 2""",
    "acronyms": f"""WITH {_D}, a AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b[A-Z]{{2,}}\\b'))) AS acronym FROM d)
SELECT acronym, count(*) AS documents FROM a WHERE acronym NOT IN ({", ".join(f"'{w}'" for w in T.KNOWN_ACRONYMS)}) GROUP BY 1""",
    "paper_refs": r"""WITH m AS (
  SELECT feedback_id, trim(coalesce(nugget_id, ''), ' ') AS cited, coalesce(query, '') || ' \cite{' || trim(coalesce(nugget_id, ''), ' ') || '} of ' || coalesce(paper_id, '') AS t FROM nugget_feedback
), c AS (SELECT feedback_id, list_filter(list_transform(string_split(cited, ','), lambda x: trim(x)), lambda x: x <> '') AS keys, t FROM m),
a AS (SELECT feedback_id, keys, list_transform(regexp_extract_all(' ' || t || ' ',
  '(?:^|[^\d.])((?:1\d|2[0-4])(?:0[1-9]|1[0-2])[._]\d{4,5})(?:[^\d]|$)', 1), lambda x: replace(x, '_', '.')) AS nums FROM c),
r AS (SELECT feedback_id, list_distinct(list_concat(keys, nums)) AS refs, list_concat(keys, nums) AS raw FROM a),
d AS (SELECT feedback_id, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS refs FROM r),
u AS (SELECT feedback_id, unnest(range(0, len(refs))) AS k, refs FROM d)
SELECT refs[k + 1] AS ref, count(*) AS messages, max(k) AS last_place FROM u GROUP BY 1
""",
    "terminology": f"""WITH {_D}, t AS ({" UNION ALL ".join(
        f"SELECT doc_id, {i} AS synonyms, len(regexp_extract_all(lower(text), '{name.lower()}')) AS n FROM d"
        for i, names in enumerate(NAMES_OF_ONE) for name in names)})
SELECT doc_id, synonyms, count(*) AS terms, CAST(sum(n) AS BIGINT) AS uses FROM t WHERE n > 0 GROUP BY 1, 2 HAVING count(*) > 1""",
    "section_detect": f"""WITH {_D}, l AS (
  SELECT doc_id, i, lower(trim(x[i])) AS l FROM (
    SELECT doc_id, list_filter(string_split(regexp_replace(text, '(?m)^#+\\s*', '', 'g'), chr(10)), lambda s: trim(s, ' ') <> '')[1:8] AS x FROM d
  ), unnest(range(1, 9)) AS r(i) WHERE i <= len(x)
), h AS (SELECT doc_id, i, {_HEAD} AS s FROM l),
r AS (SELECT doc_id, i, {_HEAD} AS s FROM (SELECT doc_id, i, regexp_replace(l, '{T.ROMAN_HEADING}', '') AS l FROM l WHERE regexp_matches(l, '{T.ROMAN_HEADING}'))),
f AS (SELECT d.doc_id, coalesce((SELECT arg_min(s, i) FROM h WHERE h.doc_id = d.doc_id AND s IS NOT NULL),
  (SELECT arg_min(s, i) FROM r WHERE r.doc_id = d.doc_id AND s IS NOT NULL AND s <> 'abstract'), '(none)') AS section FROM d)
SELECT section, count(*) AS documents FROM f GROUP BY 1""",
    "reference_filter": f"""WITH {_C}, m AS (
  SELECT paper_id, chunk_id, {_WORDS.format(t='text')} AS w, len(regexp_extract_all(text, '\\[\\d+\\]|\\(\\d{{4}}\\)|et al\\.|pp\\.|vol\\.|doi:|arXiv:')) AS k,
    len(regexp_extract_all(text, '(?m)^\\s*\\[\\d+\\]')) AS e,
    list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ') <> '') AS l FROM c
), f AS (SELECT paper_id, chunk_id, w >= 20 AND (k / w::DOUBLE > 0.02 AND k >= 3 OR e >= 3) AS dense,
  len(l) > 0 AND len(list_filter(l, lambda s: regexp_matches(s, '^\\s*\\[?\\d+\\]?\\s'))) / greatest(len(l), 1)::DOUBLE > 0.4 AS numbered FROM m)
SELECT * FROM f WHERE dense OR numbered""",
    "min_length_filter": f"""WITH {N} SELECT coalesce(section, '(none)') AS section, count(*) AS nuggets FROM n
WHERE length(trim(question, ' ')) >= 10 AND length(trim(answer, ' ')) >= 10
  AND coalesce(lower(trim(section)), '') NOT IN ('references', 'acknowledgments', 'bibliography') GROUP BY 1""",
    "document_strings": f"""WITH {N}, s AS (SELECT nugget_id, '[' || coalesce(type, '') || '] [' || coalesce(section, '') || '] Q: ' || coalesce(question, '') || ' A: ' || coalesce(answer, '') AS s FROM n)
SELECT nugget_id, md5(s) AS digest, length(s) AS chars FROM s""",
    "clamped_quality": f"""WITH {N}, q AS (SELECT CAST(CASE WHEN thesis_relevance IS NULL THEN 3 ELSE least(greatest(thesis_relevance, 1), 5) END AS INTEGER) AS relevance,
  CAST(CASE WHEN overall_score IS NULL OR isnan(overall_score) THEN 3 ELSE least(greatest(floor(overall_score), 1), 5) END AS INTEGER) AS overall FROM n)
SELECT relevance, overall, least(relevance, overall) AS least, count(*) AS nuggets FROM q GROUP BY 1, 2""",
    "citation_density": f"""WITH {_C}, k AS (SELECT coalesce(section, '(none)') AS section, {_WORDS.format(t='text')} AS w, len(regexp_extract_all(text, '\\[\\d+\\]')) AS k FROM c)
SELECT coalesce(section, '(all)') AS section, CAST(sum(w) AS BIGINT) AS words, CAST(sum(k) AS BIGINT) AS cites,
  {half_up_sql('sum(k) * 100 / sum(w)::DOUBLE', 3)} AS density FROM k GROUP BY ROLLUP (section)""",
    "section_balance": f"""WITH {_C}, g AS (SELECT coalesce(section, '(none)') AS section, CAST(sum({_WORDS.format(t='text')}) AS BIGINT) AS words FROM c GROUP BY 1),
s AS (SELECT avg(words) AS mean, stddev_samp(words) AS dev FROM g)
SELECT section, words, {half_up_sql('words / mean', 3)} AS ratio, {half_up_sql('dev / mean', 3)} AS variation,
  words / mean < 0.25 OR words / mean > 3 AS odd FROM g, s""",
    "author_share": f"""WITH {P}, a AS (SELECT trim(unnest(CASE WHEN starts_with(authors, '[') THEN
    CASE WHEN json_valid(authors) THEN CAST(json_extract_string(authors, '$[*]') AS VARCHAR[]) ELSE [] END
    ELSE string_split(authors, ';') END)) AS author FROM p WHERE authors IS NOT NULL),
g AS (SELECT author, count(*) AS papers FROM a WHERE author <> '' GROUP BY 1)
SELECT author, papers, {half_up_sql('papers * 100 / (sum(papers) OVER ())::DOUBLE', 2)} AS percent, papers * 100 / (sum(papers) OVER ())::DOUBLE > 15 AS dominant FROM g""",
    "sentences": f"""WITH {_D}, s AS (SELECT doc_id, {_SENT} AS s FROM d)
SELECT doc_id, CAST(i AS INTEGER) AS sentence_no, s[i] AS sentence FROM s, unnest(range(1, len(s) + 1)) AS r(i)""",
    "hedging": f"""WITH {_D}, s AS (SELECT source, unnest({_SENT}) AS s FROM d), k AS (
  SELECT source, contains(lower(s), 'cite') OR contains(s, '[') AS c, regexp_matches(lower(s), '{"|".join(T.HEDGES)}') AS h,
    regexp_matches(lower(s), '{"|".join(T.CLAIMS)}') AS k FROM s
), g AS (SELECT source, CASE WHEN c THEN 'cited' WHEN k AND NOT h THEN 'strong' WHEN h THEN 'hedged' ELSE 'neutral' END AS strength, count(*) AS sentences FROM k GROUP BY 1, 2)
SELECT source, strength, sentences, {half_up_sql('sentences * 100 / (sum(sentences) OVER (PARTITION BY source))::DOUBLE', 1)} AS percent FROM g""",
    "flesch_kincaid": f"""WITH {_D}, b AS (
  SELECT doc_id, greatest({_WORDS.format(t='text')}, 1) AS words, greatest(len({_SENT}), 1) AS sentences,
    coalesce(list_sum(list_transform(list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: {_BARE.format(t='w')}), lambda w: w <> ''),
      lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))), 0)::BIGINT AS syllables
  FROM d
)
SELECT doc_id, words, sentences, syllables, {half_up_sql('0.39::DOUBLE * (words / sentences::DOUBLE) + 11.8::DOUBLE * (syllables / words::DOUBLE) - 15.59', 1)} AS grade,
  {half_up_sql('206.835::DOUBLE - 1.015::DOUBLE * (words / sentences::DOUBLE) - 84.6::DOUBLE * (syllables / words::DOUBLE)', 1)} AS ease FROM b""",
}

QUERIES = {
    f.__name__: f
    for f in (
        word_paragraph_counts, sentences, flesch_kincaid, ai_patterns, first_person, hedging, normalize_title, bigram_terms,
        unigram_terms, entity_terms, acronyms, terminology, section_detect, reference_filter, min_length_filter,
        document_strings, clamped_quality, chapter_overview, consecutive_citations, paper_refs, citation_density, section_balance, author_share,
    )
}
