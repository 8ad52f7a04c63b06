import itertools
import os

import pytest
from pyspark.sql import functions as F

from lodestone.llm.mixing import TOKENIZER, mix_sources, plan, route

needs_vocabulary = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")


def test_flow_prefers_fresh_tokens():
    patterns = {("a",): 100, ("b",): 50, ("a", "b"): 30}
    got = route(patterns, {"a": 120, "b": 60}, {"a": 3, "b": 1})
    to = {s: sum(x.get(s, 0) for x in got.values()) for s in "ab"}
    assert to == {"a": 120, "b": 60} and got["a", "b"] == {"a": 20, "b": 10}


def test_flow_is_cheapest():
    for sizes in itertools.product((5, 9), repeat=3):
        patterns = dict(zip([("a",), ("b",), ("a", "b")], sizes))
        q = {"a": 12, "b": 7}
        got = route(patterns, q, {"a": 2, "b": 2})
        moved = sum(sum(x.values()) for x in got.values())
        cost = sum(max(0, sum(x.values()) - patterns[k]) for k, x in got.items())
        best = None  # all splits of the shared pattern
        for x in range(0, 2 * sizes[2] + 1):
            for y in range(0, 2 * sizes[2] - x + 1):
                a, b = 12 - x, 7 - y
                if 0 <= a <= 2 * sizes[0] and 0 <= b <= 2 * sizes[1]:
                    c = max(0, a - sizes[0]) + max(0, b - sizes[1]) + max(0, x + y - sizes[2])
                    best = c if best is None else min(best, c)
        assert moved == 19 and cost == best


def test_plan_keeps_shares():
    quotas, _ = plan({("a",): 10, ("b",): 1000}, {"a": 1.0, "b": 1.0, "gone": 5.0}, {"a": 4, "b": 2, "gone": 1}, None)
    assert quotas["a"] == quotas["b"] and 39 <= quotas["a"] <= 40
    assert plan({}, {"a": 1.0}, {"a": 1}, None) == ({}, {})


def test_flow_passes_tokens_between_sources():
    """a can only be filled when b gives the shared pattern back and takes c's."""
    patterns = {("a", "b"): 10, ("b", "c"): 10, ("c",): 10}
    got = route(patterns, {"a": 10, "b": 10, "c": 10}, dict.fromkeys("abc", 1))
    assert {s: sum(x.get(s, 0) for x in got.values()) for s in "abc"} == {"a": 10, "b": 10, "c": 10}


def test_flow_over_many_patterns():
    names = [f"s{i:02}" for i in range(17)]
    patterns = {tuple(n for k, n in enumerate(names) if m >> k & 1): 1 + m % 97 for m in range(1, 1 << 16)}
    total = sum(patterns.values())
    quotas = {n: total // 20 for n in names[:16]}
    got = route(patterns, quotas, dict.fromkeys(names, 2))
    assert {s: sum(x.get(s, 0) for x in got.values()) for s in quotas} == quotas
    assert all(sum(x.values()) <= patterns[k] for k, x in got.items())


@needs_vocabulary
@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no tables")
def test_shares_of_the_tables(spark):
    """Every source lies within half a document per pattern of its quota, and caps hold."""
    from lodestone.llm import queries as Q

    folder = "/root/testdata/sf0.01"
    shares = Q.p8_shares(spark, folder).collect()
    filled = [r for r in shares if r.quota_tokens]
    assert len(filled) > 5 and all(abs(r.tokens - r.quota_tokens) <= r.within for r in filled)
    assert abs(sum(r.target_share for r in shares) - 1) < 1e-9 and abs(sum(r.actual_share for r in shares) - 1) < 1e-9
    total = sum(r.quota_tokens for r in shares)
    assert all(abs(r.quota_tokens / total - r.target_share) < 1e-4 for r in shares)
    cap = {r.source: r.max_repeats for r in spark.read.parquet(f"{folder}/mix_targets.parquet").collect()}
    assert all(1 <= r.repeats <= cap[r.source] for r in Q.p8_mixture(spark, folder).collect())


@needs_vocabulary
def test_documents(spark):
    rows = [(i, f"text {i} has some words here " * (1 + i % 3), "ab"[i % 4 == 0], "") for i in range(400)]
    rows += [(1000, "shared text", "a", ""), (1001, "shared text", "b", ""), (1002, None, "a", ""), (1003, "", "a", ""), (1004, "odd", None, ""), (1005, "odd", "zz", ""), (None, "odd one", "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight string")
    targets = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, 5), ("c", 1.0, 1), ("a", None, None), (None, 1.0, 1), ("d", 0.0, 1), ("e", float("nan"), 2)], "source string, weight double, max_repeats int")
    go = lambda seed=1, d=docs: mix_sources(d, F.col("doc_id"), F.col("text"), F.col("source"), targets, seed=seed)
    sel, shares = go()
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"a", "b", "c", "d", "e"} and abs(s["a"].actual_share - 0.5) < 0.05 and s["c"].tokens == 0
    assert abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    rows = sel.collect()
    assert all(r.repeats <= {"a": 2, "b": 5}[r.source] for r in rows) and {1001, 1002, 1003, 1004, 1005}.isdisjoint(r.id for r in rows)
    assert sorted(rows) == sorted(go()[0].collect())
    empty, none = go(d=docs.limit(0))
    assert empty.count() == 0 and none.count() == 5
