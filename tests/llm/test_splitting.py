import random
import re

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from lodestone.llm.queries import CHUNK_LIMIT, CHUNK_OVERLAP
from lodestone.llm.splitting import STEP, split_texts, token_count


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "id int, text string, piece string, n_pieces string")
    out = split_texts(df, "text", **kw).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.id, r["_piece"])):
        by.setdefault(r.id, []).append(r.piece_text)
    return by, out


def test_pieces_cover_the_text(spark):
    text = "\n\n".join(" ".join(f"p{k}w{i}" + ("." if i % 9 == 8 else "") for i in range(47)) for k in range(9))
    by, out = run(spark, [text, "short one", "", "   ", None, text.replace("\n\n", " ").replace(".", "")], limit=60, overlap=10)
    for i in (0, 5):
        pieces = [p.split() for p in by[i]]
        assert all(len(p) <= 60 for p in pieces)
        whole = list(pieces[0])
        for a, b in zip(pieces, pieces[1:]):
            assert a[-10:] == b[:10]
            whole += b[10:]
        assert whole == text.replace(".", "").split() if i == 5 else whole == text.split()
    assert all(p.endswith(".") or p.split()[-1].endswith("w46") for p in by[0])
    assert by[1] == ["short one"] and by[2] == [""] and by[3] == ["   "] and 4 not in by


def test_long_words_are_cut(spark):
    by, _ = run(spark, ["x" * 95 + " end"], limit=4, overlap=0, max_word_chars=10)
    assert "".join(by[0]).replace(" ", "") == "x" * 95 + "end" and all(len(p) <= 44 for p in by[0])


def test_very_long_text(spark):
    by, _ = run(spark, ["word " * 100_000], limit=400, overlap=50)
    assert len(by[0]) > 280 and all(len(p.split()) <= 400 for p in by[0])


def test_unicode_space_and_errors(spark):
    df = spark.createDataFrame([("a b c d",)], "t string")
    assert df.select(token_count(F.col("t"))).first()[0] == 4
    with pytest.raises(ValueError):
        split_texts(df, "t", limit=5, overlap=5)
    assert split_texts(df.limit(0), "t", limit=5).count() == 0


def pieces_by_hand(text, limit, overlap):
    """The same pieces from token spans, without the operator's expressions."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    if len(spans) <= limit:
        return [text]
    ends = [*[a for a, _ in spans[1:]], len(text)]
    words = [text[a:b] for a, b in spans]
    gaps = [text[b:e] for (_, b), e in zip(spans, ends)]
    core = limit - overlap
    step = min(STEP, max(1, core // 2))
    sentence = [bool(re.search(r"[.!?。…][\"'”’)\]]{0,2}$", w)) and g != "" for w, g in zip(words, gaps)]
    strength = [
        4 if g.count("\n") > 1 else 3 if s else 2 if "\n" in g else 1 if w[-1] in ",;:–—" and g else 0
        for w, g, s in zip(words, gaps, sentence)
    ]
    units, i = [], 0
    while i < len(words):
        top = min(i + step, len(words))
        natural = [j for j in range(i, top) if strength[j] >= 2 or j == len(words) - 1]
        clause = [j for j in range(i, top) if strength[j] == 1]
        j = natural[0] if natural else clause[-1] if clause else top - 1
        units.append((i, j + 1))
        i = j + 1
    out, at = [], 0
    while at < len(units):
        begin = units[at][0]
        fit = [k for k in range(at, len(units)) if units[k][1] - begin <= core]
        if fit[-1] < len(units) - 1:
            good = [k for k in fit if (units[k][1] - begin) * 2 > core]
            end = max(good, key=lambda k: (strength[units[k][1] - 1], k)) if good else fit[-1]
        else:
            end = fit[-1]
        first = max(0, begin - overlap) if begin else 0
        out.append(text[spans[first][0] : ends[units[end][1] - 1]].strip())
        at = end + 1
    return out


def test_all_chunks_as_by_hand(spark):
    chunks = spark.read.parquet(f"{TESTDATA}/chunks.parquet").where("text IS NOT NULL").select("text").distinct()
    rng = random.Random(4)
    wild = [
        "".join(rng.choice(["w", "wo.", "x,", "y!\")", "z"]) + rng.choice([" ", " ", " ", "\n", "\n\n", " \n \n "]) for _ in range(n))
        for n in (9, 40, 200, 900)
    ]
    for limit, overlap in ((CHUNK_LIMIT, CHUNK_OVERLAP), (60, 10), (7, 0), (1, 0)):
        rows = [r.text for r in chunks.collect()] + wild
        by, _ = run(spark, rows, limit=limit, overlap=overlap)
        for i, text in enumerate(rows):
            assert by[i] == pieces_by_hand(text, limit, overlap), (limit, i)


@pytest.mark.parametrize("limit", [400, 4_000, 32_000])
def test_limits_beyond_the_depth_of_a_match(spark, limit):
    text = " ".join(f"w{i}" for i in range(70_000))
    by, _ = run(spark, [text], limit=limit, overlap=limit // 8)
    pieces = [p.split() for p in by[0]]
    assert all(len(p) <= limit for p in pieces)
    assert pieces[0] + [w for p in pieces[1:] for w in p[limit // 8 :]] == text.split()
