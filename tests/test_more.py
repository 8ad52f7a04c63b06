"""Settings and the smaller text functions."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.config import effective, load_settings
from lodestone.functions import text as T
from lodestone.operators.ranking import title_boost


def test_settings(tmp_path):
    assert effective("background").max_per_paper == 2 and effective("background", max_per_paper=7).max_per_paper == 7
    assert effective("nonsense").n_retrieve == 60 and effective(rerank_weight=3.0, rerank_top_n=0).rerank_weight == 1.0
    with pytest.raises(TypeError):
        effective(nonsense=1)
    (tmp_path / "s.json").write_text(json.dumps({"paths": {"a": "~/x", "b": 3}}))
    assert not load_settings(str(tmp_path / "s.json"))["paths"]["a"].startswith("~")


def test_text(spark):
    df = spark.createDataFrame([("see \\cite{a,b} and 2303.08778v2 or 0903.1234 or 2010_12345 or 2303.08778",)], "t string")
    assert df.select(T.paper_references(F.col("t"))).first()[0] == ["a", "b", "2303.08778", "2010.12345"]
    page = spark.createDataFrame([("arXiv:1 cs\nme@x.org address\nA Fine Title of a Paper\nJ. Doe and Me\nAbstract",)], "t string")
    assert page.select(T.title_line(F.col("t"))).first()[0] == "A Fine Title of a Paper"
    ids = spark.createDataFrame([("a b/c",), ("x" * 90,)], "t string").select(T.safe_id(F.col("t")).alias("i")).collect()
    assert ids[0].i == "a_b_c" and len(ids[1].i) == 81
    q = spark.range(1).select(T.format_for_embedding(F.lit("q"), F.lit(None).cast("string")), T.format_for_embedding(F.lit("q"), F.lit("a"), "find")).first()
    assert q[0] == "Q: q\nA: " and q[1] == "Instruct: find\nQuery: q"
    b = spark.range(1).select(title_boost(F.lit("how does FlowNet work"), F.lit("FlowNet: learning"), T.TITLE_STOPWORDS), title_boost(F.lit("what is it"), F.lit("What else"), T.TITLE_STOPWORDS)).first()
    assert list(b) == [2.0, 1.0]
