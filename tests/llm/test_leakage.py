import random

from pyspark.sql import functions as F

from lodestone.llm.leakage import WordSearch, leaked_items


def test_search_against_brute_force():
    rng = random.Random(2)
    items = [(i, [rng.choice("abc") for _ in range(rng.randrange(2, 30))]) for i in range(40)]
    s = WordSearch(items, run=6, block=3)
    for _ in range(300):
        doc = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        runs = {tuple(doc[i : i + 6]) for i in range(len(doc) - 5)}
        want = {k for k, w in items if any(tuple(w[i : i + 6]) in runs for i in range(len(w) - 5))}
        assert s.found(doc) == want


def test_documents(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi."
    near = "alpha <b>BETA</b> gamma\ndelta, epsilon &nbsp; **zeta** eta — the­ta i​ota kappa ｌambda mu"
    rows = [(1, f"Before. {near} after", ""), (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", ""), (3, None, ""), (4, "", ""), (1, f"Before. {near} after", ""),
            (5, "x " * 200_000 + item, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string")
    items = spark.createDataFrame([(9, item, ""), (9, item, ""), (8, "too short", ""), (None, item, ""), (7, None, "")], "item_id long, text string, id string")
    go = lambda d, i: sorted((r.id, r.item) for r in leaked_items(d, F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("text")).collect())
    assert go(docs, items) == [(1, 9), (5, 9)]
    assert go(docs.limit(0), items) == [] and go(docs, items.limit(0)) == []


def test_passes(spark, monkeypatch):
    from lodestone.llm import leakage

    monkeypatch.setattr(leakage, "WORDS_PER_PASS", 20)
    texts = [" ".join(f"i{k}w{j}" for j in range(15)) for k in range(5)]
    items = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "d int, t string")
    got = sorted((r.id, r.item) for r in leaked_items(docs, F.col("d"), F.col("t"), items, F.col("i"), F.col("t")).collect())
    assert got == [(k, k) for k in range(5)]


def test_shorter_runs(spark):
    """Items below twelve words count where the run is shorter."""
    docs = spark.createDataFrame([(1, "so a b c d e f g h i it is"), (2, "a b c d e f g x h i")], "d int, t string")
    items = spark.createDataFrame([(5, "a b c d e f g h i")], "i int, t string")
    found = leaked_items(docs, F.col("d"), F.col("t"), items, F.col("i"), F.col("t"), run=8)
    assert [tuple(r) for r in found.collect()] == [(1, 5)]


def test_an_item_longer_than_a_pass(spark, monkeypatch):
    from lodestone.llm import leakage

    monkeypatch.setattr(leakage, "WORDS_PER_PASS", 7)
    long = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(long[k : k + 12])) for k in range(29)], "d int, t string")
    items = spark.createDataFrame([(1, " ".join(long))], "i int, t string")
    got = sorted(r.id for r in leaked_items(docs, F.col("d"), F.col("t"), items, F.col("i"), F.col("t")).collect())
    assert got == list(range(29))


def test_tables_of_a_full_pass_are_small():
    """Two million words of items, a fifth of them distinct, within 500 MB of a process."""
    import subprocess
    import sys

    code = (
        "import resource, random; from lodestone.llm.leakage import *\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "r = random.Random(1); make = lambda k: (k, [f'w{r.randrange(400_000)}' for _ in range(200)])\n"
        "s = WordSearch(map(make, range(WORDS_PER_PASS // 200)))\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, len(s.flat))"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=200).stdout.split()
    assert int(out[0]) < 500_000 and int(out[1]) == 2_000_000
