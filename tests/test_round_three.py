"""Titles and text searches at the size of whole collections: the same results without all with all."""

import difflib
import random

from pyspark.sql import functions as F

from lodestone.operators import similarity

WORDS = "hybrid sparse stereo buffer voxel kernel pose target map precision tracking gated bounded".split()


def titles(rng, n):
    name = lambda: "".join(rng.choice(["mor", "vin", "ka", "lo", "zar", "pel"]) for _ in range(4))
    return [f"{name()} {rng.choice(WORDS)} {rng.choice(WORDS)} for {rng.choice(WORDS)} {rng.choice(WORDS)}" for _ in range(n)]


def blocks(t):
    return {w for w in t.split(" ")[:6] if len(w) >= 3}


def test_titles_that_all_share_a_word(spark, monkeypatch):
    """All pairs as by hand, in several blocks; the plan joins on no word of the titles."""
    rng = random.Random(1)
    right = titles(rng, 300)
    left = [t if rng.random() < 0.3 else "".join(c for c in t if rng.random() > rng.random() * 0.3) for t in right[:200]]
    left += [left[0], None, "", "for a map", "a b c", "é" * 6 + " for sparse maps", "for " + "x" * 90]
    right += [right[0], None, "", "for a maps", "a b c", "é" * 6 + " for sparse map", "for " + "x" * 95]
    a = spark.createDataFrame([(k, t) for k, t in enumerate(left)] + [(0, left[0])], "id int, title string")
    b = spark.createDataFrame([(k, t) for k, t in enumerate(right)], "id int, title string")
    want = {}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            if x and y and blocks(x) & blocks(y) and (r := difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()) >= 0.85:
                want[i, j] = r
    monkeypatch.setattr(similarity, "TITLES_PER_PASS", 70)
    out = similarity.fuzzy_title_join(a, b)
    rows = out.collect()
    assert len(rows) == len(want) > 100 and {(r.id_a, r.id_b): r.ratio for r in rows} == want
    assert "explode(" not in out._jdf.queryExecution().executedPlan().toString()


def test_discovery_joins_no_titles_by_word(spark, tmp_path, monkeypatch):
    """Candidates whose titles all share a word: no join on words, whole result."""
    import datetime

    from lodestone.plans import ingest

    plans, join = [], ingest.fuzzy_title_join

    def seen(left, right):
        out = join(left, right)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(ingest, "fuzzy_title_join", seen)
    old = titles(random.Random(3), 60)
    new = [f"{t}s" for t in old[:20]] + [f"{k} things for them" for k in ("violets", "ouzo")] + ["quarks for jazz bands", "quarks for jazz band"]
    at = datetime.datetime(2024, 1, 1)
    rows = [(f"k{k}", None, t, None, None, at) for k, t in enumerate(old)] + [(f"c{k:02}", "discovered", t, None, None, at) for k, t in enumerate(new)]
    spark.createDataFrame(rows, "paper_id string, source string, title string, arxiv_id string, doi string, added_at timestamp_ntz").write.parquet(f"{tmp_path}/papers.parquet")
    assert {r["reason"]: r["candidates"] for r in ingest.discovery_dedup(spark, str(tmp_path)).collect()} == {"fuzzy_title": 20, "cross_source": 1, "kept": 3}
    assert len(plans) == 2 and not any("explode(" in p for p in plans)


def searched(texts, queries, k):
    """BM25 by hand, any word: query -> [(id, score in steps)]."""
    import math

    words = {i: t.split() for i, t in texts}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for q, query in queries:
        total = dict.fromkeys(words, 0.0)
        for u in dict.fromkeys(query.split()):
            n = sum(u in w for w in words.values())
            if n:
                idf = max(math.log((len(words) - n + 0.5) / (n + 0.5)), 1e-6)
                for i, w in words.items():
                    tf = w.count(u)
                    total[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        out[q] = [(i, round(s, 6)) for i, s in sorted(total.items(), key=lambda x: (-math.floor(x[1] * 1e9), x[0])) if s > 0][:k]
    return out


def test_search_leaves_out_only_what_cannot_be_among_the_best(spark, monkeypatch):
    from lodestone.operators import lexical

    rng = random.Random(2)
    common = [f"c{i}" for i in range(8)]
    rare = [f"r{i}" for i in range(150)]
    texts = [(i, " ".join(rng.choices(common, k=rng.randrange(5, 30)) + rng.choices(rare, k=rng.randrange(6)))) for i in range(900)]
    texts += [(i + 900, t) for i, t in texts[:60]]  # copies: ties go to the smaller id
    queries = [(i, " ".join(dict.fromkeys(rng.sample(texts[i][1].split(), 5) + rng.choices(rare, k=i % 3)))) for i in range(0, 960, 12)]
    queries += [(5, "c1 c2"), (7, "unknown"), (11, "r1 c1 c1")]
    monkeypatch.setattr(lexical, "FEW", 20)
    t = spark.createDataFrame(texts, "id long, t string")
    q = spark.createDataFrame(queries, "q long, s string")
    ask = lambda **more: lexical.bm25(q, t, 7, query_id="q", query="s", text_id="id", text=F.col("t"), mode="or", **more).collect()
    got = {}
    for r in sorted(ask(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    want = searched(texts, queries, 7)
    assert got == {k: v for k, v in want.items() if v}
    own = {r["query_id"]: r["rank"] for r in ask(own=True) if r["query_id"] == r["id"]}
    assert own == {k: n for k, v in want.items() for n, (i, _) in enumerate(v, 1) if i == k} and len(own) > 20
    assert all(r["query_id"] in want and (r["id"], round(r["score"], 6)) in want[r["query_id"]] for r in ask(own=True))
    # Of the texts of a whole index only a few are scored.
    assert len(ask(own=True)) < len(ask())


def test_own_ranks_ask_for_nothing_worse(spark, tmp_path, monkeypatch):
    from lodestone.plans import curation

    hits, search = [], curation.bm25

    def seen(*args, **kwargs):
        out = search(*args, **kwargs)
        hits.extend(out.collect())
        return out

    monkeypatch.setattr(curation, "bm25", seen)
    rows = [(50, "green elk on ice", "", "claim", "a"), (49, "green elk on ice", "", "claim", "a"), (100, "owl", "", "claim", "a"), (150, None, "x", "claim", "a")]
    rows += [(i, "green ice", "elk", "claim", "a") for i in range(1, 20)]
    spark.createDataFrame(rows, "row_id long, question string, answer string, type string, section string").write.parquet(f"{tmp_path}/nuggets.parquet")
    r = curation.self_retrieval_ranks(spark, str(tmp_path)).collect()
    assert [(x["queries"], x["rank_1"], x["rank_2_5"], x["not_found"]) for x in r] == [(3, 1, 1, 1)]
    assert sorted((x["query_id"], x["id"]) for x in hits) == [(50, 49), (50, 50), (100, 100)]


def test_phrases_are_counted_by_one_look_at_each_word():
    """Many phrases with one first word: a text is not held against each of them."""
    from lodestone.operators import lexical

    class Words(list):
        looks = 0

        def __getitem__(self, at):
            Words.looks += 1
            return super().__getitem__(at)

    count = lexical._counter([f"3 {k}" for k in range(500)] + ["3 7 3", "a", "a 3 7 9"])
    text = Words("3 7 3 7 a 3 499 3 7 3 a a 3".split())
    assert count(text) == {"3 7": 3, "3 499": 1, "3 7 3": 2, "a": 3}
    assert Words.looks <= 2 * len(text)


def test_first_look_leaves_few_texts_of_middling_words():
    """No rare word in a query and no bound yet: the best are found without scoring most texts whole."""
    import numpy as np
    import pyarrow as pa

    from lodestone.operators import lexical

    rng = np.random.default_rng(4)
    n, words, k = 5_000, 60, 5
    held = [np.sort(rng.choice(words, rng.integers(8, 25), False)) for _ in range(n)]
    lists = lambda x, kind: pa.array([y.tolist() for y in x], pa.list_(kind))
    tfs = [rng.integers(1, 3, len(h)) for h in held]
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([len(h) + 9 for h in held], pa.int32()), lists(held, pa.int32()), lists(tfs, pa.int32())], names=["id", "dl", "u", "tf"])
    idf = rng.random(words) * 3 + 0.1
    index = lexical._Index([b], idf, 20.0)
    units = [rng.choice(words, 12, False).astype(np.int32) for _ in range(150)]
    begin = np.arange(0, 12 * 150 + 1, 12)
    ask = lambda bounds: index.reach(begin, np.concatenate(units), np.ones(12 * 150, np.int32), bounds, k)
    cold = list(ask(np.full(150, -np.inf)))
    assert sum(len(at) for _, at, _ in cold) < 150 * n / 20
    best = lambda found: lexical._best(*(np.concatenate(x) for x in zip(*((q, s, index.ids[at]) for q, at, s in found))), k, 150)
    q, score, ids, bound = best(cold)
    base = lexical.K1 * (1 - lexical.B + lexical.B * (np.array([len(h) for h in held]) + 9) / 20.0)
    for i, us in enumerate(units):
        whole = np.array([sum(idf[u] * f * 2.2 / (f + base[t]) for u, f in zip(held[t], tfs[t]) if u in us) for t in range(n)]) if i < 12 else None
        if whole is not None:
            want = np.lexsort((np.arange(n), -np.floor(whole * 1e9)))[:k]
            assert ids[q == i].tolist() == want.tolist() and np.allclose(score[q == i], whole[want])
    again = best(ask(bound))
    assert all(np.array_equal(x, y) for x, y in zip(again, (q, score, ids, bound)))


def test_own_texts_of_many_queries_are_scored_together(monkeypatch):
    """With the own text's score as bound, only what is as good is found; no call of numpy's per query and text."""
    import numpy as np
    import pyarrow as pa

    from lodestone.operators import lexical

    rng = np.random.default_rng(5)
    n, words = 3_000, 80
    held = [np.sort(rng.choice(words, rng.integers(10, 25), False)) for _ in range(n)]
    lists = lambda x: pa.array([y.tolist() for y in x], pa.list_(pa.int32()))
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([len(h) for h in held], pa.int32()), lists(held), lists([np.ones_like(h) for h in held])], names=["id", "dl", "u", "tf"])
    index = lexical._Index([b], rng.random(words) * 3 + 0.1, 17.0)
    units = [rng.choice(held[i], 8, False).astype(np.int32) for i in range(0, n, 10)]
    own = np.array([index.score(np.array([10 * i]), us, np.ones(8, np.int32))[0] for i, us in enumerate(units)])
    whole = [index.score(np.arange(n), us, np.ones(8, np.int32)) for us in units]
    monkeypatch.setattr(lexical._Index, "score", None)
    found = list(index.reach(np.arange(0, 8 * len(units) + 1, 8), np.concatenate(units), np.ones(8 * len(units), np.int32), own - 2e-9, 50))
    assert len(found) <= len(units) / 20
    q, at, score = (np.concatenate(x) for x in zip(*found))
    for i, w in enumerate(whole):
        good = (q == i) & (score >= own[i] - 2e-9)
        assert sorted(at[good]) == np.flatnonzero(w >= own[i] - 2e-9).tolist() and np.allclose(score[q == i], w[at[q == i]])


def test_titles_with_the_same_characters_are_not_all_matched(monkeypatch):
    """Counts of characters and pairs rule little out here; characters in common in their order do."""
    import difflib
    import random

    import numpy as np
    import pyarrow as pa

    from lodestone.operators import similarity

    class Counted(difflib.SequenceMatcher):
        asked = 0

        def ratio(self):
            Counted.asked += 1
            return super().ratio()

    monkeypatch.setattr(similarity.difflib, "SequenceMatcher", Counted)
    rng = random.Random(8)
    words = [a + b for a in ("lan", "mer", "sol", "tri") for b in ("nel", "ron", "sal", "tem")]
    mixed = [" ".join(rng.sample(words, 12)) for _ in range(60)]
    right = [*mixed, *(t[:20] + "x" + t[21:] for t in mixed[:20])]
    left = mixed[:30]

    class Sent:
        value = similarity.TitleMarks(right)

    found = list(similarity._title_search(Sent, 0.85)(iter([pa.RecordBatch.from_arrays([pa.array(left)], names=["ta"])])))
    got = sorted((a, b) for batch in found for a, b, _ in zip(*(c.to_pylist() for c in batch.columns)))
    asked = Counted.asked
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b, False).ratio()
    assert got == sorted((a, b) for a in left for b in right if ratio(a, b) >= 0.85) and len(got) >= 50
    marks = similarity.TitleMarks(left)
    may = len(similarity._alike(marks, Sent.value, 0.85)[0])
    assert asked <= len(got) * 2 and asked < may / 4
    # Long titles have several words of bits.
    common = lambda a, b: max(row[-1] for row in _table(a, b))

    def _table(a, b):
        rows = [[0] * (len(b) + 1)]
        for x in a:
            rows.append([0])
            for k, y in enumerate(b):
                rows[-1].append(rows[-2][k] + 1 if x == y else max(rows[-2][k + 1], rows[-1][k]))
        return rows

    some = ["".join(rng.choice("ab -0") for _ in range(n)) for n in (3, 63, 64, 65, 128, 129, 200)]
    marks = similarity.TitleMarks(some)
    i, j = (x.ravel() for x in np.mgrid[:7, :7])
    assert similarity._in_order(marks, marks, i, j).tolist() == [common(some[a], some[b]) for a, b in zip(i, j)]


def test_few_pairs_are_decided_in_one_job_and_as_in_rounds(spark, monkeypatch):
    import random

    from lodestone.operators import similarity

    rng = random.Random(6)
    pairs = sorted({tuple(sorted(rng.sample(range(150), 2))) for _ in range(260)} | {(k, k + 1) for k in range(150, 159)})
    d = spark.createDataFrame(pairs, "id_a long, id_b long")
    gone = set()
    for b in range(160):
        if any(a not in gone for a, x in pairs if x == b):
            gone.add(b)
    cuts, cut = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda x: cuts.append(1) or cut(x))
    assert sorted(r.id for r in similarity.greedy_keep(d).collect()) == sorted(gone)
    assert len(cuts) == 1
    monkeypatch.setattr(similarity, "PAIRS_ON_DRIVER", 120)
    assert sorted(r.id for r in similarity.greedy_keep(d).collect()) == sorted(gone)
    assert len(cuts) > 3
    assert similarity.greedy_keep(d.where("id_a < 0")).collect() == []


def test_units_are_counted_in_many_texts_at_once(monkeypatch):
    """Any characters, phrases that overlap, texts without words, words of one bucket: as text by text."""
    import random

    import numpy as np

    from lodestone.operators import lexical

    rng = random.Random(1)
    letters = ["a", "b", "ab", "é", "ß", "_", "3", "½", "日", "\n", " ", "-", "aⒶ", "x́", "\U0001d518", "\U0001f600"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(600)] + ["a a a a", "b" * 300, "a\nb"]
    words = sorted({w for t in texts for w in lexical._WORD.findall(t)})
    phrases = {" ".join(rng.choices(words[:40], k=rng.choice([2, 2, 3, 4]))) for _ in range(300)} | {" ".join(lexical._WORD.findall(t)[:n]) for t in texts[::5] for n in (1, 2, 3)}
    units = sorted({*rng.sample(words, 100), *phrases, "a", "a a", "a a a", "aⒶ", "a aⒶ", "b" * 300} - {""})
    one = lexical._counter(units)
    for at_once in (lexical.CODES_AT_ONCE, 7):
        monkeypatch.setattr(lexical, "CODES_AT_ONCE", at_once)
        known = lexical._Units(units)
        dl, held, u, tf = known.count(texts)
        ends = np.cumsum(held)
        assert not known.clash and dl.tolist() == [len(lexical._WORD.findall(t)) for t in texts]
        for t, s, e in zip(texts, ends - held, ends):
            assert {units[a]: n for a, n in zip(u[s:e], tf[s:e])} == one(lexical._WORD.findall(t))
    assert sum(tf) > 1_000 and any(" " in units[a] for a in u)
    # A word with the hash of another is not taken for it, and units of one hash are noticed.
    known = lexical._Units(["owl", "elk"])
    hashes = lexical._Units._hashes
    monkeypatch.setattr(lexical._Units, "_hashes", staticmethod(lambda c, start, size: np.resize(known.hash[:1], len(start))))
    assert known.count(["owl elm owl"])[2:][0].tolist() == [0] and known.count(["owl elm owl"])[3].tolist() == [2]
    assert lexical._Units(["owl", "elk"]).clash
    monkeypatch.setattr(lexical._Units, "_hashes", staticmethod(hashes))


def test_own_scores_of_all_tasks_are_made_in_one_job(spark, monkeypatch):
    from lodestone.operators import lexical

    cuts, cut = [], lexical.cut
    monkeypatch.setattr(lexical, "cut", lambda d: cuts.append(d.columns) or cut(d))
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["owl on ice", "elk", "owl", "low-light elk on ice", None])], "id long, t string").repartition(4)
    got = lexical.bm25(texts, texts, 9, query_id="id", query="t", text_id="id", text=lexical.F.col("t"), mode="or", own=True).collect()
    assert cuts == [["q", "score"]]
    assert {(r["query_id"], r["id"]) for r in got if r["query_id"] == r["id"]} == {(i, i) for i in range(4)}
