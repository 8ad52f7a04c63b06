"""Sections, references, records, expected retrievals, streams over several batches, searches in blocks."""

import datetime
import random

import numpy as np
from conftest import TESTDATA
from pyspark.sql import functions as F

from lodestone import providers
from lodestone.functions import text as T
from lodestone.operators import chunking, evaluation, parsing, store, vectors
from lodestone.plans import manuscripts
from lodestone.streaming import feedback


def test_section_windows_stay_within_sections(spark):
    words = lambda k, n: " ".join(f"s{k}w{i}" + ("." if i % 9 == 8 else "") for i in range(n))
    pages = [("p", 1, "intro", words(1, 50)), ("p", 2, "intro", words(2, 30)), ("p", 3, None, words(3, 5)), ("p", 4, "intro", words(4, 12)), ("q", 1, "x", None)]
    df = spark.createDataFrame(pages, "paper string, page int, section string, text string")
    rows = sorted(chunking.section_windows(df, "paper", "page", "section", "text", 40, 10, 0.3).collect(), key=lambda r: (r.paper, r.chunk))
    assert [r.chunk for r in rows] == list(range(len(rows))) and {r.paper for r in rows} == {"p"}
    assert [r.section for r in rows][-2:] == ["preamble", "intro"] and rows[0].pages == [1, 2] and rows[-1].pages == [4]
    first = [r for r in rows if r.pages == [1, 2]]
    assert all(r.token_end - r.token_start <= 40 for r in first) and first[0].text.endswith(".")
    whole = (words(1, 50) + "\n" + words(2, 30)).split()
    assert all(r.text.split() == whole[r.token_start : r.token_end] for r in first) and first[-1].token_end == 80


def test_section_chunks_of_the_tables_by_hand(spark):
    """Every chunk of the small tables stands in its section's text at its tokens, all tokens are covered."""
    c = spark.read.parquet(f"{TESTDATA}/chunks.parquet").where("trim(paper_id) <> ''").distinct().collect()
    sections = {}
    for r in sorted({(r.paper_id.strip().lower(), r.chunk_id, r.section or "preamble", r.text or "") for r in c}):
        sections.setdefault(r[0], []).append(r)
    w = chunking.section_windows(
        spark.createDataFrame([(p, n, s, t) for rows in sections.values() for p, n, s, t in rows], "p string, n int, s string, t string"), "p", "n", "s", "t", 120, 20
    ).collect()
    covered = {}
    for r in w:
        text = "\n".join(t for _, n, s, t in sections[r.paper] if s == r.section and n in r.pages)
        assert r.text.split() == text.split()[r.token_start : r.token_end]
        covered.setdefault((r.paper, tuple(r.pages)), set()).update(range(r.token_start, r.token_end))
    for (paper, pages), tokens in covered.items():
        text = "\n".join(t for _, n, s, t in sections[paper] if n in pages)
        assert tokens == set(range(len(text.split())))
    assert manuscripts.section_chunks(spark, TESTDATA).count() == len(w)


def test_reference_entries():
    text = "[2] A. Lee. Stray number.\n1. Anna Smith and B. Lee. A long title with words. In Proc. of Tests, pp. 3-9, 2019.\n2. C. Doe, D. Roe. Gates of events at night. Springer LNCS, vol. 4, 2021.\n3. E. Poe et al. Another title without place. 2018."
    entries = parsing.reference_list(text)
    fields = [parsing.reference_fields(e) for e in entries]
    assert len(entries) == 3 and [f["year"] for f in fields] == ["2019", "2021", "2018"]
    assert fields[0]["title"] == "A long title with words" and fields[0]["authors"] == "Anna Smith and B. Lee" and "Tests" in fields[0]["venue"]
    assert fields[1]["title"] == "Gates of events at night" and fields[1]["venue"].startswith("Springer LNCS")
    assert fields[2]["title"] == "Another title without place" and parsing.reference_fields("")["title"] == ""
    long = "A. B. " + "word " * 100 + "end. Springer, 2020."
    assert len(parsing.reference_fields(long)["title"]) > 400  # nothing is cut off


def test_latex_parts(spark):
    tex = "\\section{One}\nText \\ref{fig:a} \\begin{figure*}[t]\n\\caption[x]{A cap}\n\\label{fig:a}\\end{figure*}\n\\subsection*{Two}\n\\begin{table}no\\end{table}"
    r = spark.createDataFrame([(tex,), ("",)], "t string").select(T.figures(F.col("t")).alias("f"), T.tex_sections(F.col("t")).alias("s")).collect()
    assert [tuple(x) for x in r[0].f] == [("figure", "A cap", "fig:a"), ("table", None, None)]
    assert [(x.level, x.title) for x in r[0].s] == [(1, "One"), (2, "Two")] and r[1].f == [] and r[1].s == []


def test_expected_recall(spark):
    e = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c"), (3, None), (4, "z")], "query_id int, item string")
    r = spark.createDataFrame([(1, "a"), (1, "x"), (2, "c"), (9, "c")], "query_id int, item string")
    got = {x.query_id: (x.expected, x.found, x.recall, x.passed) for x in evaluation.expected_recall(e, r).collect()}
    assert got == {1: (2, 1, 0.5, False), 2: (1, 1, 1.0, True), 4: (1, 0, 0.0, False)}
    assert sorted(map(tuple, evaluation.missing_items(e, r).collect())) == [(1, "b"), (4, "z")]


def test_store_operators(spark):
    rows = spark.createDataFrame([("a", "  ", None, 1), ("b", "short", "d", None), ("c", None, None, None)], "k string, t string, d string, y int")
    other = spark.createDataFrame([("a", "a longer text", "da", 5), ("b", "a longer text", "db", 6)], "k string, t string, d string, y int")
    got = {r.k: (r.t, r.d, r.y) for r in store.fill_empty(rows, other, "k", ["t", "d", "y"], least=1).collect()}
    assert got == {"a": ("a longer text", "da", 1), "b": ("short", "d", 6), "c": (None, None, None)}
    assert store.fill_empty(rows, other, "k", ["t"], least=10).where("k = 'b'").first().t == "a longer text"
    schema = "paper string, id string, score double"
    unified = spark.createDataFrame([("p", "p1", 4.0)], schema)
    raw = spark.createDataFrame([("p", "p1", 1.0), ("p", "p2", 1.0), ("q", "q1", 1.0), ("q", "q2", 5.0)], schema)
    better = spark.createDataFrame([("q1", 3.0), ("p2", 3.0)], "id string, score double")
    added = spark.createDataFrame([("q", "q9", 2.0), ("p", "p9", 2.0), ("new", "n9", 2.0)], schema)
    got = sorted(map(tuple, store.preferred(unified, raw, "paper", "id", better, added).collect()))
    assert got == [("p", "p1", 4.0), ("q", "q1", 3.0), ("q", "q2", 5.0), ("q", "q9", 2.0)]
    p = spark.createDataFrame([("1", "x", None, "t", None), ("2", None, "d", "t", 7), ("3", None, None, "zz", None)], "paper_key string, arxiv string, doi string, title string, year int")
    r = spark.createDataFrame([("x", None, "t", 1), (None, "d", None, 2), ("x", None, None, 0), (None, None, "t", 3)], "arxiv string, doi string, title string, year int")
    assert {x.paper_key: (x.how, x.year) for x in store.enriched(p, r, ["year"]).collect()} == {"1": (1, 0), "2": (2, 7), "3": (None, None)}


def test_providers():
    class Counting:
        seen = 0

        def embed(self, texts):
            self.seen += len(texts)
            return np.array([[float(len(t))] for t in texts])

    inner = Counting()
    e = providers.CachedEmbedder(inner, size=2)
    assert e.embed(["a", "bb", "a"]).tolist() == [[1.0], [2.0], [1.0]] and inner.seen == 2
    e.embed(["a", "ccc"])
    e.embed(["bb"])  # the longest unused one was given up
    assert inner.seen == 4
    assert providers.passage_prompt(["m", "m", "r"], {"m": "M"}, "G") == "M" and providers.passage_prompt(["m", "r"], {"m": "M"}, "G") == "G"
    assert providers.passage_prompt([], {}, "G") == "G" and providers.passage_prompt(["x"], {"m": "M"}, "G") == "G"


def test_claims_meet_their_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES_PER_PASS", 4)
    rng = np.random.default_rng(1)
    rows = [(i, f"g{i % 3}" if i else None, [float(x) for x in rng.normal(size=5)]) for i in range(40)] + [(99, "alone", [1.0, 0.0, 0.0, 0.0, 0.0]), (98, "g1", None)]
    v = spark.createDataFrame(rows, "vec_id long, g string, embedding array<double>").repartition(3)
    got = {r.query_id: (r.compared, r.distance) for r in vectors.nearest_within(v.where("vec_id % 3 = 0 OR vec_id > 90").withColumnRenamed("vec_id", "q"), v, query_id="q", vector_id="vec_id", group="g").collect()}
    unit = {i: np.array(e) / np.linalg.norm(e) for i, _, e in rows if e}
    want = {}
    for i, g, e in rows:
        others = [1 - unit[i] @ unit[j] for j, h, f in rows if h == g and g and f and j != i] if e else []
        if (i % 3 == 0 or i > 90) and others:
            want[i] = (len(others), min(others))
    assert set(got) == set(want) and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12 for i in want)


def test_nearest_over_several_batches(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(3)) for _ in range(3)]) for i in range(500)]  # many ties
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = vectors.nearest(v.where("vec_id < 5").withColumnRenamed("vec_id", "query_id"), v, 7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = {i: np.array(e) / (np.linalg.norm(e) or 1.0) for i, e in rows}
    for q in range(5):
        want = sorted((1.0 - float(unit[q] @ unit[i]), i) for i in unit)
        mine = [(r.distance, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert len(mine) == 7 and np.allclose([d for d, _ in mine], [d for d, _ in want[:7]])


def test_streams_go_on_and_count_late_rows(spark, tmp_path):
    at = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def counts():
        stream = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(source)
        return {(r.day, r.event_type): r.events for r in feedback.event_counts(spark, "", target, stream).collect()}

    add = lambda rows: spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(source)
    add([(at(1), "a"), (at(9), "a")])
    add([(at(1, 3), "a"), (at(9), "b")])  # later than any watermark of the first file would allow
    assert counts() == {("2024-01-01", "a"): 2, ("2024-01-09", "a"): 1, ("2024-01-09", "b"): 1}
    add([(at(1, 5), "a")])
    assert counts()["2024-01-01", "a"] == 3


def test_kept_ratings_survive_a_restart(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "feedback_id long, nugget_id string, query string, rating int, created_at string"

    def latest():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return {(r.nugget_key, r.query): r.rating for r in feedback.feedback_latest(spark, "", target, stream).collect()}

    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    add([(1, "A", "q", 1, "2024-01-05"), (2, "b", "q", 1, "2024-01-05")])
    add([(3, "a ", "q", -1, "2024-01-06"), (4, "b", "q", -1, "2024-01-01")])
    assert latest() == {("a", "q"): -1, ("b", "q"): 1}
    add([(5, "a", "q", 0, None), (6, "c", "r", 1, "2024-02-01"), (7, "b", "q", 0, "2024-03-01")])
    assert latest() == {("a", "q"): -1, ("b", "q"): 0, ("c", "r"): 1}


def test_index_records(spark):
    from lodestone.sources import records

    search = '{"data": [{"paperId": "a", "title": "One", "year": 2020, "authors": [{"name": "A. B"}], "externalIds": {"ArXiv": "2001.00001", "DOI": "10.1/X"}, "citationCount": 3}, {"paperId": "b", "title": " "}]}'
    batch = '[{"paperId": "c", "title": "Three", "venue": "arXiv 2002.00002v3"}]'
    cited = '{"data": [{"citedPaper": {"paperId": "d", "title": "Four"}}, {"citingPaper": {"paperId": "e", "title": "Five"}}]}'
    df = spark.createDataFrame([(search,), (batch,), (cited,), ("{broken",), (None,)], "raw string")
    got = {r.record_id: r for r in records.scholar_records(df, "raw").collect()}
    assert set(got) == set("acde") and got["a"].authors == ["A. B"] and got["a"].doi == "10.1/x" and got["c"].arxiv == "2002.00002" and got["d"].citations == 0
    works = '{"results": [{"id": "W1", "display_name": "Work", "publication_year": 2021, "doi": "https://doi.org/10.2/Y", "cited_by_count": 5, "abstract_inverted_index": {"of": [1], "Work": [0], "art": [2]}, "authorships": [{"author": {"display_name": "C"}}], "primary_location": {"landing_page_url": "https://arxiv.org/abs/2003.00003", "source": {"display_name": "arXiv"}}}]}'
    r = records.open_records(spark.createDataFrame([(works,), ("[]",)], "raw string"), "raw").collect()
    assert len(r) == 1 and (r[0].abstract, r[0].doi, r[0].arxiv, r[0].authors, r[0].citations) == ("Work of art", "10.2/y", "2003.00003", ["C"], 5)
    ids = spark.createDataFrame([("1401_65034",), ("x",), ("1401.6503v2",)], "i string").select(records.arxiv_id(F.col("i"))).collect()
    assert [x[0] for x in ids] == ["1401.65034", None, "1401.6503"]
