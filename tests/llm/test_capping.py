import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm.capping import _middle, cap_per_contributor

SCHEMA = "paper string, id string, score double, v int, owner string, kept string, low double"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "x", 0.0) for r in rows], SCHEMA)
    kw.setdefault("max_count", 3)
    out = cap_per_contributor(df, F.col("paper"), F.col("id"), F.col("score"), version=[F.col("v")], low=1.0, high=5.0, **kw)
    return {r.id: (r.owner, r.score, r.kept) for r in out.collect()}


def brute(rows, cap):
    latest = {}
    for p, i, s, v in rows:
        if p is None or i is None:
            continue
        key = (v is not None, v or 0)
        if i not in latest or key >= latest[i][0]:
            latest[i] = (key, p, s if s is not None and s == s and 1 <= s <= 5 else None)
    by = {}
    for i, (_, p, s) in latest.items():
        by.setdefault(p, []).append((-(s if s is not None else -1), i))
    return {i: k < cap(len(g)) for g in by.values() for k, (_, i) in enumerate(sorted(g))}


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        p = rng.choice(["hot"] * 3 + [f"p{k % 40}"])
        rows.append((p, f"{p}_{rng.randrange(400)}é" if k % 5 else f"n{k}", rng.choice([None, float("nan"), 0.5, 9.0, 1.0, 2.5, 2.5, 3.0, 4.0, rng.random() * 6]), k))
    want = brute(rows, lambda n: 5)
    assert {i: r[2] for i, r in run(spark, rows, max_count=5).items()} == want
    want = brute(rows, lambda n: max(1, int(n * 0.3 + 1e-9)))
    assert {i: r[2] for i, r in run(spark, rows, max_count=None, max_share=0.3).items()} == want


def test_ties_repeats_and_nulls(spark):
    rows = [("p", c, 2.0, 1) for c in "fedcba"] + [("p", "a", 2.0, 1), (None, "z", 5.0, 1), ("p", None, 5.0, 1), ("q", "y", None, None)]
    got = run(spark, rows)
    assert sorted(i for i, r in got.items() if r[2]) == ["a", "b", "c", "y"] and "z" not in got and got["y"][1] is None
    assert all(not r[2] for r in run(spark, rows, max_count=0).values())


def test_latest_row_counts(spark):
    got = run(spark, [("p", "a", 5.0, 1), ("p", "a", 1.0, 2), ("p", "b", 2.0, 1)], max_count=1)
    assert got["a"] == ("p", 1.0, False) and got["b"][2]


def test_empty(spark):
    assert run(spark, []) == {}
    with pytest.raises(ValueError):
        run(spark, [], max_count=None)


def test_middle():
    for low, high in [("a", "b"), ("a", "ab"), ("x_1", "x_2"), ("", "a"), ("é", "\U0001f600"), ("a퟿", "a")]:
        m = _middle(low, high)
        assert low < m <= high


def test_rounds_are_bounded_whatever_the_scores(spark, monkeypatch):
    """A null score, 10,000 negative scores and magnitudes from 1e-300 to 1e300."""
    from lodestone.llm import capping

    rounds = []
    cut = capping.cut
    monkeypatch.setattr(capping, "cut", lambda df: rounds.append(1) or cut(df))
    scores = [None, *[-float(k) for k in range(10_000)], *[s * 10.0**e for e in range(-300, 301, 25) for s in (1, -1)]]
    df = spark.createDataFrame([("p", f"i{k:05d}", s) for k, s in enumerate(scores)], "paper string, id string, score double")
    out = cap_per_contributor(df, F.col("paper"), F.col("id"), F.col("score"), max_count=9_900)
    kept = {r.id for r in out.where("kept").collect()}
    order = sorted(range(len(scores)), key=lambda k: (scores[k] is None, -(scores[k] or 0), f"i{k:05d}"))
    assert kept == {f"i{k:05d}" for k in order[:9_900]}
    assert len(rounds) < 70


def test_only_unusable_scores_at_the_cut(spark):
    rows = [("p", f"i{k}", None if k else 2.0, 1) for k in range(8)]
    assert {i for i, r in run(spark, rows, max_count=3).items() if r[2]} == {"i0", "i1", "i2"}
