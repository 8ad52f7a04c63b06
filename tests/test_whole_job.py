"""Operators and queries that must do the whole job: no row, word or rank is cut off."""

import datetime

from lodestone.operators import ranking
from lodestone.plans import curation, ingest, retrieval


def test_blend_keeps_candidates_beyond_top(spark):
    rows = [(1, i, 1.0 / i, float(i % 3)) for i in range(1, 8)]
    got = {r["id"]: r for r in ranking.blend(spark.createDataFrame(rows, "query_id int, id int, rrf double, ce double"), top=3).collect()}
    assert sorted(got) == list(range(1, 8))
    assert all(got[i]["blended"] == got[i]["rrf"] for i in range(4, 8))
    assert got[3]["blended"] == 0.4 * got[3]["rrf"]
    assert got[2]["blended"] == 0.4 * 0.5 + 0.6


def test_lists_search_the_whole_question_to_full_length(spark, tmp_path):
    asked = "Does sparse lidar localisation benefit perception scheduling before odometry?"
    rows = [(50, asked, "")] + [(i, "odometry", f"drift {i}") for i in range(100, 170)] + [(i, "other", "words") for i in range(200, 400)]
    spark.createDataFrame(rows, "row_id long, question string, answer string").write.parquet(f"{tmp_path}/nuggets.parquet")
    spark.createDataFrame([(r[0], [1.0, r[0] / 1000]) for r in rows if r[0] % 50 or r[0] == 50], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = retrieval._lists(spark, str(tmp_path)).where("query_id = 50").groupBy("list").count().collect()
    assert {r["list"]: r["count"] for r in got} == {"vector": 60, "bm25": 60}


def test_late_nuggets_are_deduplicated_against_each_other(spark, tmp_path):
    old, new = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 8, 1)
    words = [f"w{i}" for i in range(60)]
    text = lambda start, n=20: " ".join(words[start : start + n])
    rows = [
        ("a", old, text(0)), ("b", old, text(0)),  # both early: no concern of this query
        ("c", new, text(0)), ("d", new, text(2)),  # c is known; d is like c (18 of 22), and like a and b
        ("e", new, text(30)), ("f", new, text(32)), ("g", new, text(34)),  # f is like e; g only like f, which goes
    ]
    spark.createDataFrame([(i, t, k, "p", q, "") for k, (i, t, q) in enumerate(rows)], "nugget_id string, ingested_at timestamp_ntz, row_id long, paper_id string, question string, answer string").write.parquet(f"{tmp_path}/nuggets.parquet")
    got = {r[0] for r in curation.near_dup_vs_existing(spark, str(tmp_path)).collect()}
    assert got == {"c", "d", "f"}


def test_discovery_matches_identifiers_rows_and_chains(spark, tmp_path):
    chain = ["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilxx zexx", "alpha beta gamma dexxa epsilxx zexx"]
    rows = [
        ("k1", None, "Known work on sensors", "1111.1111", "10.1/K"),
        ("c1", "discovered", "Renamed entirely", "9999.0001", "10.1/k"),  # known DOI, unknown arXiv id
        ("c2", "discovered", "", "1111.1111", None),  # known id, blank title
        ("c3", "discovered", "Quantum lattices melt", "2222.2222", None),
        ("c4", "discovered", "Completely different name", "2222.2222", None),  # id of c3
        ("c5", "discovered", "Repeated row", None, None),
        ("c5", "discovered", "Repeated row", None, None),
    ] + [(f"d{i}", "discovered", t, None, None) for i, t in enumerate(chain)]  # the middle one goes, the last is not like the first
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(*r, at) for r in rows], "paper_id string, source string, title string, arxiv_id string, doi string, added_at timestamp_ntz").write.parquet(f"{tmp_path}/papers.parquet")
    got = {r["reason"]: r["candidates"] for r in ingest.discovery_dedup(spark, str(tmp_path)).collect()}
    assert got == {"exact_id": 2, "cross_source": 3, "kept": 4}


def test_evaluations_query_with_the_whole_text(spark, tmp_path):
    stub = "controlled localisation perception scheduling"
    rows = [(50, f"{stub} of an elk", "", "claim"), (1, stub, "", "claim")]
    spark.createDataFrame(rows + [(i, "other", "", "claim") for i in range(2, 30)], "row_id long, question string, answer string, type string").write.parquet(f"{tmp_path}/nuggets.parquet")
    spark.createDataFrame([(1, "draft", f"{stub} elk"), (2, "draft", f"{stub} owl")], "item_id long, mode string, text string").write.parquet(f"{tmp_path}/canary_items.parquet")
    spark.createDataFrame([(1, f"{stub} elk"), (2, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["rank"] for r in curation._own_ranks(spark, str(tmp_path)).collect()] == [1]
    assert [(r["items"], r["with_hits"]) for r in curation.canary_recall(spark, str(tmp_path)).collect()] == [(2, 1)]
