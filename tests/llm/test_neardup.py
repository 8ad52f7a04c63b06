import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import neardup as N

SCHEMA = "id string, q string, a string, cls string, text string, k int"


def run(spark, rows, threshold=0.75):
    df = spark.createDataFrame([(*r, "", "", 0) for r in rows], SCHEMA)
    members, links = N.near_duplicates(df, F.col("id"), F.col("q"), F.col("a"), threshold=threshold)
    pairs = {(r.id_a, r.id_b) for r in N.expanded_pairs(members, links).collect()}
    return members, links, pairs


def brute(rows, threshold=0.75):
    sets = {}
    for i, q, a in rows:
        if i is not None:
            sets[i] = frozenset(re.findall("[a-z0-9]+", f"{q or ''} {a or ''}".lower()))
    ids = sorted(i for i in sets if sets[i])
    return {(x, y) for n, x in enumerate(ids) for y in ids[n + 1 :] if len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y])}


def texts(rng, n):
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(n):
        base = rng.sample(words, rng.randrange(25, 60))
        rows.append((f"d{k:05}", " ".join(base[:10]), " ".join(base[10:])))
        if k % 4 == 0:
            edited = [w if rng.random() > 0.06 else rng.choice(words) for w in base]
            rng.shuffle(edited)
            rows.append((f"e{k:05}", " ".join(edited[:10]), " ".join(edited[10:])))
    return rows


def test_recall_and_precision(spark):
    rows = texts(random.Random(5), 800)
    got, want = run(spark, rows)[2], brute(rows)
    assert len(want) > 100 and got <= want and len(got) >= 0.98 * len(want)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [("a", "One two three four", None), ("b", "one TWO", "three, four!"), ("b", "one TWO", "three, four!"), ("c", None, ""), ("d", "", None),
            (None, "one two three four", ""), ("e", "zz", long), ("f", "yy", long)]
    members, links, pairs = run(spark, rows)
    assert pairs == {("a", "b"), ("e", "f")}
    assert {r.id for r in members.collect()} == {"a", "b", "e", "f"}
    assert run(spark, [])[2] == set()


def test_copies_are_one_class(spark):
    rows = [(f"c{i:03}", "same text of five words", "yes") for i in range(60)]
    members, links, pairs = run(spark, rows)
    assert members.select("cls").distinct().count() == 1 and links.count() == 0 and len(pairs) == 60 * 59 // 2


def banded_rows(sets, threshold):
    width, bands = N.band_plan(threshold)
    r = N.SetSketcher(width * bands).registers(sets)
    s1, s2 = N.signatures(r, np.array([len(s) for s in sets]), threshold)
    return r, s1, s2


def batch_of(keys, cls, s1, s2):
    ks = (np.asarray(keys, np.int64).view(np.uint64) << np.uint64(32)) | (s2 & np.uint64(0xFFFFFFFF))
    s3 = (s2 >> np.uint64(32)).astype(np.uint32).view(np.int32)
    columns = [ks.view(np.int64), np.asarray(cls, np.int64), s1.view(np.int64), s3]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ks", "cls", "s1", "s3"])


def edited_sets(rng, n, share):
    out = []
    for k in range(n):
        base = [f"b{k}_{i}" for i in range(40)]
        out += [base, [w if rng.random() > share else f"{w}x" for w in base]]
    return out


def test_long_buckets_are_banded_again(monkeypatch):
    """One bucket in several batches: pair by pair, banded again, and passed on as hot."""
    rng = random.Random(3)
    sets = edited_sets(rng, 300, 0.03)
    _, s1, s2 = banded_rows(sets, 0.75)
    cls = np.arange(600)
    every = {(2 * k, 2 * k + 1) for k in range(300)}
    batches = [batch_of(np.full(200, 7), cls[i : i + 200], s1[i : i + 200], s2[i : i + 200]) for i in range(0, 600, 200)]
    batches.append(batch_of([9, 9], [0, 1], s1[:2], s2[:2]))

    def found(block, held):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "HELD", held)
        pairs, hot = [], 0
        for b in N._compare_sorted(0.75)(iter(batches)):
            for x, y, k in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k is None:
                    pairs.append((x, y))
                else:
                    assert k == 7
                    hot += 1
        return set(pairs), hot

    direct, hot = found(2_000, 10_000)
    assert hot == 0 and len(every & direct) >= 299
    again, hot = found(50, 10_000)
    assert hot == 0 and again <= direct and len(again & every) >= 0.95 * len(every)
    passed, hot = found(50, 250)
    assert passed == {(0, 1)} and hot == 600


def test_hot_blocks_meet(spark, monkeypatch):
    sets = edited_sets(random.Random(4), 200, 0.03)
    _, s1, s2 = banded_rows(sets, 0.75)
    rows = [(k, int(a), 5, int(b)) for k, a, b in zip(range(400), s1.view(np.int64), s2.view(np.int64))]
    monkeypatch.setattr(N, "HELD", 90)
    got = {(r.a, r.b) for r in N._hot_candidates(spark.createDataFrame(rows, "a long, b long, k long, s long"), 0.75).collect()}
    want = {(2 * k, 2 * k + 1) for k in range(200)}
    assert len(got & want) >= 0.95 * len(want) and len(got) < 1.1 * len(want)


def test_work_per_record_does_not_depend_on_the_number_of_records():
    assert N.band_plan(0.75) == (5, 24) and N.band_plan(0.8)[0] == 5


def test_joint_estimates():
    """The error of the joint estimate against exact similarity, for sets of unequal sizes."""
    rng = random.Random(2)
    pairs = []
    for _ in range(400):
        shared, a, b = rng.randrange(5, 80), rng.randrange(0, 60), rng.randrange(0, 30)
        s = [f"s{rng.random()}" for _ in range(shared)]
        pairs.append((s + [f"a{rng.random()}" for _ in range(a)], s + [f"b{rng.random()}" for _ in range(b)]))
    m = 120
    sketch = N.SetSketcher(m)
    ra, rb = (sketch.registers([p[k] for p in pairs]) for k in (0, 1))
    na, nb = (np.array([len(p[k]) for p in pairs], float) for k in (0, 1))
    exact = np.array([len(set(x) & set(y)) / len(set(x) | set(y)) for x, y in pairs])
    error = N.estimates(ra, rb, na, nb) - exact
    expected = np.sqrt(np.mean([N.estimate_error(e, np.array([x]), np.array([y]), m)[0] ** 2 for e, x, y in zip(exact, na, nb)]))
    assert abs(error.mean()) < 0.006 and np.sqrt((error**2).mean()) < 1.15 * expected
    # Knowing the sizes makes it better than the share of equal registers.
    assert (error**2).mean() < 0.9 * (((ra == rb).mean(axis=1) - exact) ** 2).mean()


def test_registers_estimate_similarity():
    s = N.SetSketcher(2000)
    a, b = [f"a{i}" for i in range(60)], [f"a{i}" for i in range(20, 80)]
    r = s.registers([a, b, a])
    assert abs((r[0] == r[1]).mean() - 0.5) < 0.06 and (r[0] == r[2]).all()
    whole = s.registers([a + b])[0]
    assert (np.maximum(r[0], r[1]) == whole).all()  # registers of a union are the maxima


def test_pairs_do_not_depend_on_the_length_of_a_bucket(spark, monkeypatch):
    """The same rows as a short, a long and a hot bucket: the same pairs, likely or just so."""
    sets = edited_sets(random.Random(8), 400, 0.12)
    _, s1, s2 = banded_rows(sets, 0.75)
    cls = np.arange(800)
    x = {"k": np.full(800, 7), "cls": cls, "s1": s1, "s2": s2}
    i, j = N._likely(x, *np.triu_indices(800, 1), 0.75)
    want = {*zip(i.tolist(), j.tolist())}
    monkeypatch.setattr(N, "TILE", (7, 100))

    def found(block, held):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "HELD", held)
        return {p for b in N._compare_sorted(0.75)(iter([batch_of(x["k"], cls, s1, s2)])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}

    assert found(2_000, 10_000) == want and found(50, 10_000) == want
    monkeypatch.setattr(N, "HELD", 90)
    rows = [(k, int(a), 5, int(b)) for k, a, b in zip(range(800), s1.view(np.int64), s2.view(np.int64))]
    assert {(r.a, r.b) for r in N._hot_candidates(spark.createDataFrame(rows, "a long, b long, k long, s long"), 0.75).collect()} == want
