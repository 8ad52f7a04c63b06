"""Parsers against hand-made input."""

from lodestone.operators import parsing as P
from lodestone.operators.citekeys import resolve_keys


def test_json_objects():
    one = '{"question": "q", "answer": "a"}'
    assert P.json_objects(f"[{one}]") == P.json_objects(f"Sure:\n```json\n[{one}]\n```") == [{"question": "q", "answer": "a"}]
    assert len(P.json_objects(f"[{one}, {one}, " + '{"question": "br')) == 2
    assert len(P.json_objects('{"nuggets": [' + one + "]}")) == 1
    assert len(P.json_objects('{"nuggets": [' + one + ", {")) == 1
    assert P.json_objects("none") is None and P.json_objects("") is None and P.json_objects("[1, 2]") is None


def test_extracted_pairs(spark):
    raw = '[{"question": "What is it now?", "answer": "It is a thing.", "relevance": 9, "specificity": "x"}, {"question": "short", "answer": "no"}]'
    df = spark.createDataFrame([("a", raw), ("b", None), ("c", "garbage")], "id string, raw string")
    r = P.extracted_pairs(df, "id", "raw").collect()
    assert len(r) == 1 and (r[0].id, r[0].type, r[0].relevance, r[0].specificity, r[0].overall) == ("a", "background", 5, 3, 3)


def test_references(spark):
    text = "References\n[1] A. Smith and B. Lee, \"A long quoted title,\" in IEEE Trans. Testing, vol. 3, pp. 1-9, 2019.\n[2] C. Doe. Another fine ti-\ntle here. Springer, 2020.\n[3] Nobody knows what this entry says at all"
    assert len(P.reference_list(text)) == 3
    r = {x.title: x for x in P.reference_rows(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t").collect()}
    assert r["A long quoted title"].year == "2019" and r["A long quoted title"].authors == "A. Smith and B. Lee"
    assert r["Another fine title here"].venue == "Springer" and r["Another fine title here"].authors == "C. Doe"
    assert P.reference_fields("arXiv:2101.00001 something odd")["year"] == "2021"
    assert len(P.reference_list("first entry of twenty chars\n\nsecond entry of twenty chars\n\nno")) == 2


def test_reading_order(spark):
    b = [(1, 0.0, 2.0, 100.0, 5.0, "header"), (1, 0.0, 20.0, 45.0, 30.0, "L1"), (1, 0.0, 40.0, 45.0, 50.0, "L2"), (1, 70.0, 10.0, 99.0, 30.0, "R1"), (1, 70.0, 35.0, 99.0, 50.0, "R2"),
         (1, 0.0, 95.0, 100.0, 99.0, "footer"), (2, 0.0, 30.0, 90.0, 40.0, "b"), (2, 0.0, 10.0, 90.0, 20.0, "a"), (2, 0.0, 10.0, 90.0, 20.0, "  ")]
    df = spark.createDataFrame([(*x, 100.0, 100.0) for x in b], "page_id int, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double")
    got = {r.page_id: r.text for r in P.reading_order(df).collect()}
    assert got == {1: "header\nL1\nL2\nR1\nR2\nfooter", 2: "a\nb"}


def test_inverted_index(spark):
    df = spark.createDataFrame([({"of": [1, 3], "art": [2], "Work": [0]},)], "i map<string,array<int>>")
    assert df.select(P.abstract_from_index(df.i)).first()[0] == "Work of art of"


def test_code_outline(spark):
    src = 'import x\n@dataclass\nclass A(B):\n    """Doc."""\n    n: int = 1\n    def __init__(self, k: int = 2):\n        self.m = Layer(3)\n    def run(self) -> int: ...\n    def _hidden(self): ...\ndef f(a, *, b=1): ...\n'
    df = spark.createDataFrame([("a.py", src), ("b.py", "def ("), ("c.py", None)], "file string, source string")
    r = {x.name: x for x in P.code_outline(df).collect()}
    assert set(r) == {"A", "f"} and r["A"].signature == "B" and r["A"].fields == ["n: int = 1"] and r["A"].doc == "Doc."
    assert r["A"].members == ["__init__(self, k: int=2)", "run(self) -> int"] and r["A"].components == ["self.m = Layer(3)"] and r["f"].signature == "f(a, *, b=1)"


def test_run_settings(spark):
    df = spark.createDataFrame([("r", '{"a": {"b": 1, "c": [1, 2]}, "d": "x"}'), ("bad", "{: ["), ("none", None)], "file string, source string")
    assert {(x.key, x.value) for x in P.run_settings(df).collect()} == {("a.b", "1"), ("a.c", "[1, 2]"), ("d", "x")}


def test_cite_keys(spark):
    papers = spark.createDataFrame(
        [("p1", '["A. Smith"]', 2020, "Spiking flow networks"), ("p2", "Smith; Lee", 2021, "Other work"), ("p3", None, 2019, "Deep gate of events")],
        "paper_key string, authors string, year int, title string",
    )
    keys = spark.createDataFrame([("Smith_2020:Spiking-flow",), ("Smith_2022:Other-work",), ("Nobody_2019:gate-events",), ("Nobody_2000:none",)], "cite_key string")
    r = {x.cite_key: (x.paper_key, x.how) for x in resolve_keys(keys, papers).collect()}
    assert r == {"Smith_2020:Spiking-flow": ("p1", 1), "Smith_2022:Other-work": ("p2", 2), "Nobody_2019:gate-events": ("p3", 3), "Nobody_2000:none": (None, None)}
