from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import scan_noise as S

PROSE = "the sensor keeps a shared record of every error and reports the calibration of each camera before the network runs again "


def test_page_numbers():
    number = lambda text, i: S.is_page_number(text.split("\n"), i)
    for line in ("- 4 -", "PAGE 9", "p. 12", "[p. 3]", "3 / 12", "Page 2 of 9", "7 |", "xiv", "12"):
        assert number(f"some words\n{line}\nmore words", 1), line
    assert not number("12\n14\n15", 1) and not number("a = b\n(15)\nc", 1) and not number("x\nword\ny", 1)


def test_headers():
    kind = lambda line: S.header_kind(["before", line, "after"], 1)[0]
    assert kind("SMITH ET AL.") == "sure" and kind("Smith et al. | Flow: sparse gates") == "sure" and kind("7  Flow Net on Events") == "sure"
    assert kind("Preprint. Under review.") == "series" and kind("| a | b |") is None and kind("of the gate, and the") is None


def test_editor_undoes_confusions():
    frequent = dict.fromkeys(dict.fromkeys(PROSE.split()), 500)
    model = S.train_editor(frequent)
    words = ["err0r", "sens0r", "carnera", "recorcl", "evcry", "netvvork", "repo5ts", "calibratlon"]
    hits = sum(S.corrections_of(w, model, frequent, 2) in frequent for w in words)
    assert hits >= 6
    # Held out: corrupted forms that training did not draw.
    good = total = 0
    for w in frequent:
        for d in range(200, 206):
            made = S.corrupted(w, d * 7919)
            if made and len(made[0]) > 3 and made[0] not in frequent:
                total += 1
                good += S.corrections_of(made[0], model, frequent) == w
    assert total > 50 and good / total > 0.8


def test_joiner():
    for sample in ([], [PROSE * 5 + "\n\n- item one\n- item two\n\n" + PROSE * 4]):
        j = S.train_joiner(sample)
        join = lambda a, b: (lambda s: s["join"] > s["keep"])(j.scores("line", S.line_features(a, b, 40)))
        assert join("the sensor keeps a shared record of the", "error and reports it.") and not join("- item one: 3 ms", "- item two: 4 ms")


def test_places_are_learned():
    """A number under a table is in doubt by its neighbours; its place on other pages tells."""
    page = "the sensor keeps a record\nPage {} of 90\nof every error."
    table = "Values\n12.5\n13.5\n14.5\nend."
    places = S.train_places([page.format(k) for k in range(40)] + [table.replace("5", str(k)) for k in range(40)])
    assert S.is_page_number("the sensor keeps a record\n12\nof every error.".split("\n"), 1, places)
    assert not S.is_page_number("Values\n12\n13\n14\nend.".split("\n"), 2, places)
    assert S.train_places(["One line."]) is None and S.train_places([]) is None


def test_all_edits_are_tried():
    word = "unconstitutionalisations"
    frequent = {w: 500 for w in [*PROSE.split(), word]}
    model = S.train_editor(frequent)
    for i in range(len(word)):
        for k, forms in S.CONFUSIONS.items():
            if word.startswith(k, i):
                for form in forms:
                    learned = k in model.labels[form[0]] and all(S.DELETE in model.labels[c] for c in form[1:])
                    assert not learned or S.corrections_of(word[:i] + form + word[i + len(k) :], model, frequent, 2) == word


def test_halves_and_headers_of_any_length():
    half = "x" * 90
    assert S.joined_lines(f"{half}-\nyz", lambda a, b: a + b) == f"{half}yz"
    assert S.header_kind(["A" * 70 + " " + "B" * 70], 0)[0] == "sure"


def test_valid_rare_words_stay(spark):
    """modem and tail are ordinary words beside the far more frequent modern and fail; deperid
    and carnera stand in scanned texts alone."""
    clean = [(f"c{k}", k, f"The modern camera and the modern sensor depend on it; they fail often {'with a modem and a tail' if k % 9 == 0 else ''} here.") for k in range(900)]
    scan = [(f"s{k}", k, f"The modern carnera\nPage 4 of 9\nhas an err0r and they deperid on it; they fail, the error is {k}." if k < 6 else f"The modern camera has an error\nPage 4 of 9\nhere.") for k in range(60)]
    df = spark.createDataFrame(clean + scan, "p string, c int, t string")
    args = (F.col("p"), F.col("c"), F.col("t"))
    model = S.fit(df, *args)
    fixes = {r.word: r.correct for r in model.corrections.collect()}
    assert fixes == {"carnera": "camera", "deperid": "depend", "err0r": "error"}
    assert S.company(100, 60, 0.6, 0.1) + S.PRIOR < 0 < S.company(1, 1, 0.6, 0.15) + S.PRIOR


def fixture(spark):
    body = [(f"p{i}", 0, PROSE * 6, "") for i in range(12)]
    scan = "Flow Notes on Gates, 2020\nthe sensor keeps a shared rec-\nord of every err0r and re-\nports the well-\nknown camera.\n- 4 -\nthe network runs again."
    known = [("k", i, "a well-known camera. " * 5, "") for i in range(3)]
    rows = body + known + [("p1", 7, scan, ""), ("p1", 7, scan, ""), ("p1", 8, "Flow Notes on Gates, 2020\nthe camera.", ""), ("p2", 9, None, ""), ("p2", 10, "", ""), (None, None, "the camera\n12\nruns", "")]
    return spark.createDataFrame(rows, "paper_id string, chunk_id int, text string, noise string")


def test_chunks(spark):
    df = fixture(spark)
    args = (F.col("paper_id"), F.col("chunk_id"), F.col("text"))
    model = S.fit(df, *args)
    got = sorted((r.paper or "", r.chunk or 0, r.noise) for r in S.chunk_noise(df, *args, model=model).collect())
    assert got == [("", 0, "page_number")] + [("p1", 7, k) for k in ("hyphen_break", "misread", "page_number", "running_header")] + [("p1", 8, "running_header")]
    out = {(r.paper, r.chunk): r.text for r in S.repaired_chunks(df, *args, model=model).collect()}
    assert out["p1", 7] == "the sensor keeps a shared record of every error and reports the well-known camera. the network runs again."
    assert out["p2", 9] is None and out["p2", 10] == ""
    assert S.repaired_chunks(df, *args, model=model).count() == df.count()


def test_empty(spark):
    df = fixture(spark).limit(0)
    assert S.chunk_noise(df, F.col("paper_id"), F.col("chunk_id"), F.col("text")).count() == 0


def test_words():
    assert S.words_of("The (err0r), a! mult!ply well-known") == ["The", "err0r", "mult!ply", "well", "known", "well-known"]
    assert Counter(S.words_of("")) == Counter()
