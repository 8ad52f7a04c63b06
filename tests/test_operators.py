"""Operators against hand-made cases and brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import ranking as R
from lodestone.operators import similarity, store
from lodestone.operators.chunking import flexible_chunks, protected_spans
from lodestone.operators.lexical import bm25
from lodestone.operators.references import iso_utc, orphan_references
from lodestone.operators.vectors import nearest
from lodestone.providers import HashingEmbedder, OverlapReranker, TemplateExpander
from lodestone.sources import parse_bib


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.rank): r.vec_id for r in nearest(q, df, 7, exclude_self=True).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 300, 50):
        order = sorted((1 - u[i] @ u[j], j) for j in range(300) if j != i)[:7]
        assert [got[i, k + 1] for k in range(7)] == [j for _, j in order]


def test_nearest_of_nothing(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert nearest(e.withColumnRenamed("vec_id", "query_id"), e, 3).count() == 0


def test_bm25_needs_all_words_and_phrases(spark):
    texts = spark.createDataFrame([(1, "bio inspired buffer"), (2, "inspired bio buffer"), (3, "buffer buffer only"), (4, None)], "id long, t string")
    q = spark.createDataFrame([(7, "bio-inspired buffer"), (8, "buffer"), (9, " . ")], "q long, query string")
    got = [(r.query_id, r.id) for r in bm25(q, texts, 5, query_id="q", query="query", text_id="id", text=F.coalesce("t", F.lit(""))).collect()]
    assert (7, 1) in got and (7, 2) not in got and {i for k, i in got if k == 8} == {1, 2, 3} and all(k != 9 for k, _ in got)


def test_fusion_by_hand(spark):
    lists = spark.createDataFrame([(1, 10, "a", 1, 1.0), (1, 10, "b", 2, 1.0), (1, 11, "a", 2, 1.0)], "query_id int, id int, list string, rank int, weight double")
    got = {r.id: (r.rrf, r.overlap) for r in R.fuse(lists).collect()}
    assert abs(got[10][0] - (1 / 30 + 1 / 31)) < 1e-12 and got[10][1] == 2 and abs(got[11][0] - 1 / 31) < 1e-12


def test_boosts_by_hand(spark):
    r = spark.range(1).select(
        R.relevance_boost(F.lit(5)), R.relevance_boost(F.lit(0)), R.section_boost(F.lit("Related Work"), ["related work"]),
        R.feedback_boost(F.lit(-2)), R.paper_feedback_boost(F.lit(20)), R.paper_feedback_boost(F.lit(-20)),
        R.quality_boost(F.lit(1.0)), R.quality_boost(F.lit(None).cast("double")),
        R.authority_boost(F.lit(True), F.lit(2020), F.lit("2303 08778"), F.lit(5), F.lit(0), F.lit(""), 1.0, 0.3),
        R.authority_boost(F.lit(True), F.lit(2020), F.lit("A"), F.lit(1000), F.lit(11), F.lit("Review"), 1.0, 0.3),
    ).first()
    assert [round(x, 6) for x in r] == [1.4, 1.0, 1.15, 0.5, 1.3, 0.3, 0.7, 1.0, 0.3, 1.7]


def test_diverse_selection(spark):
    rows = [(1, i, 10.0 - i, "a" if i < 5 else "b", f"p{i % 2}") for i in range(8)]
    df = spark.createDataFrame(rows, "query_id int, id int, score double, type string, paper_id string")
    got = [r.id for r in R.diverse(df, 6, 2).orderBy("place").collect()]
    assert got[:4] == [0, 1, 5, 6] and len(got) == 6 and got[4:] == [2, 3]


def test_jaccard_and_greedy_against_brute_force(spark):
    rng = random.Random(3)
    sets = {i: {rng.choice("abcdefgh") + str(rng.randrange(2)) for _ in range(6)} for i in range(120)}
    df = spark.createDataFrame([("x", i, sorted(s)) for i, s in sets.items()], "block string, id int, words array<string>")
    pairs = similarity.jaccard_pairs(df, 0.5)
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.5}
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == want
    kept = []
    for i in sets:
        if not any((k, i) in want for k in kept):
            kept.append(i)
    assert {r.id for r in similarity.greedy_keep(pairs).collect()} == set(sets) - set(kept)


def test_fuzzy_titles(spark):
    a = spark.createDataFrame([(1, "spiking flow net for events"), (2, "other thing")], "id int, title string")
    b = spark.createDataFrame([(3, "spiking flow nets for events"), (4, "")], "id int, title string")
    assert [(r.id_a, r.id_b) for r in similarity.fuzzy_title_join(a, b).collect()] == [(1, 3)]


def test_changes_and_upsert(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("c", "3", None)], "k string, id string, t string")
    new = spark.createDataFrame([("a", "1", "x"), ("b", "2", "z"), ("d", "4", "w")], "k string, id string, t string")
    got = {r.k: r.change for r in store.changes(old, new, "k", F.col("id"), F.col("t")).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    assert {r.id: r.t for r in store.upsert(old, new, ["id"]).collect()} == {"1": "x", "2": "z", "3": None, "4": "w"}


def test_flexible_chunks():
    assert flexible_chunks("a b c", 5, 1) == [(0, 3, "a b c")]
    text = " ".join(f"w{i}" + ("." if i % 10 == 9 else "") for i in range(100))
    chunks = flexible_chunks(text, 35, 5, 0.3)
    assert chunks[0][:2] == (0, 30) and chunks[0][2].endswith("w29.") and chunks[1][0] == 25 and chunks[-1][1] == 100
    table = "x y z " * 10 + "\n| a | b |\n| c | d |\n" + "t " * 40
    assert protected_spans(table)
    assert flexible_chunks("", 5, 1) == []


def test_text_functions(spark):
    assert one(spark, T.sentences, "See Fig. 3 for it. Smith et al. (2020) agree. It is 3.5 ms! Done") == ["See Fig. 3 for it.", "Smith et al. (2020) agree.", "It is 3.5 ms!", "Done"]
    assert one(spark, T.normal_title, "  The Título: A  Test-Case! ") == "the ttulo a test-case"
    assert one(spark, T.paragraphs, "a\n\nb\n \nc\\par d") == 4
    assert one(spark, T.syllables, "The made table, () area") == 5
    assert one(spark, T.section_of_block, "\n\nV. Results\nbody") is None
    assert one(spark, T.section_of_block, "x\nIII. Results\nbody") == "results"
    assert one(spark, T.section_of_block, "3.1 Related  work") == "related_work"
    assert one(spark, T.cite_keys, r"\cite{a, b} \citep[see][2]{b,c}") == ["a", "b", "c"]
    assert one(spark, T.strip_latex, "\\textbf{Hi} $x$ % no\n\\cite{k} \\gls{snn} {end}") == "Hi MATH snn end"
    assert one(spark, T.label_refs, r"\ref{f} \eqref{e} \ref{f}") == ["f", "e"]


def test_providers():
    e = HashingEmbedder(16).embed(["a b", "a b", ""])
    assert np.allclose(e[0], e[1]) and not e[2].any()
    assert OverlapReranker().score("a b", ["b c", None]) == [0.5, 0.0]
    assert TemplateExpander().variants("q", "background")[0] == ("q", "background") and len(TemplateExpander().variants("q", "draft")) == 4


def test_bib_parser():
    text = '@comment{x}\n@Article{k1, title = {A {B} c}, year = 1999, author = "D {E}"}\n@misc{k2,\n doi={10/x},}\n@book{k3, title={open'
    got = parse_bib(text)
    assert [(e[0], e[1], e[2]) for e in got] == [("article", "k1", 2), ("misc", "k2", 3), ("book", "k3", 5)]
    assert got[0][3] == {"title": "A {B} c", "year": "1999", "author": "D {E}"} and got[1][3] == {"doi": "10/x"}


def _orphans(spark, refs, targets, **kw):
    r = spark.createDataFrame(refs, "id long, k string, t timestamp, e string")
    g = spark.createDataFrame(targets, "k string, s timestamp, e timestamp, id long")
    df = orphan_references(r, g, [F.col("k")], [F.col("k")], ref_id="id", ref_table="x", ref_time=F.col("t"), target_start=F.col("s"), target_end=F.col("e"), **kw)
    return sorted((x.ref_id, x.reason, x.period) for x in df.collect())


def test_orphans(spark):
    from datetime import datetime as d

    targets = [("a", d(2020, 1, 1), d(2020, 2, 1), 1), ("a", d(2020, 3, 1), None, 1), ("b", d(2021, 1, 1), None, 1), (None, None, None, 1), ("c", None, d(2020, 1, 1), 1)]
    refs = [
        (1, "a", d(2020, 1, 15), ""), (2, "a", d(2020, 2, 1), ""), (3, "a", d(2019, 1, 1), ""), (4, "b", d(2020, 5, 1), ""),
        (5, "zz", None, ""), (6, None, d(2020, 1, 1), ""), (7, "a", None, ""), (8, "c", d(2020, 1, 1), ""), (8, "c", d(2020, 1, 1), ""), (9, "a", d(2020, 3, 1), ""),
    ]
    assert _orphans(spark, refs, targets) == [
        (2, "deleted", "2020-02"), (3, "late", "2019-01"), (4, "late", "2020-05"), (5, "missing", "unknown"), (8, "deleted", "2020-01"), (8, "deleted", "2020-01"),
    ]
    assert _orphans(spark, [], targets) == []
    assert _orphans(spark, refs[:1], []) == [(1, "missing", "2020-01")]


def test_composite_orphans(spark):
    r = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, None), (4, "b", None), (5, "a", 2)], "id long, x string, y int")
    g = spark.createDataFrame([("a", 1), ("c", None)], "x string, y int")
    got = {}
    for rule in ("simple", "partial", "full"):
        df = orphan_references(r, g, [F.col("x"), F.col("y")], [F.col("x"), F.col("y")], ref_id="id", ref_table="x", match=rule)
        got[rule] = sorted(x.ref_id for x in df.collect())
    assert got == {"simple": [5], "partial": [4, 5], "full": [2, 4, 5]}


def test_iso_times(spark):
    texts = ["2020-01-01 10:00:00", "2020-01-01T10:00:00Z", "2020-01-01T12:00:00+02:00", "2020-01-01T12:00:00+0200", "2020-01-01", "soon", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.date_format(iso_utc("t"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2020-01-01 10:00"] * 4 + ["2020-01-01 00:00"] + [None] * 3
