import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm.lookalikes import form_sql, look_classes, look_groups, look_pairs, unified_forms


def form(s):
    return duckdb.execute(f"SELECT {form_sql('$1')}", [s]).fetchone()[0]


@pytest.mark.parametrize("a, b", [
    ("ＡＢｃ１．", "ABc1."), ("ﬁne ﬂow oﬀ", "fine flow off"), ("éä", "éä"), ("a b c　d", "a b c d"),
    ("a​b­c﻿⁠", "abc"), ("сосоа", "cocoa"), ("Τορ", "Toρ"), ("ё", "ë"), ("ё", "ë"), ("Å", "Å"),
])
def test_same_look(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("é", "e"), ("m²", "m2"), ("l", "1"), ("a b", "a\nb"), ("O", "0"), ("a  b", "a b")])
def test_different_look(a, b):
    assert form(a) != form(b)


def test_form_is_stable():
    for s in ("Ёжик ﬁ ＡＢ é  x", "Ὀδυσσεύς", "ạ́"):
        assert form(form(s)) == form(s)


def test_pairs(spark):
    rows = [(1, "cocoa", ""), (2, "сосоа", ""), (3, "cocoa", ""), (4, "Cocoa", ""), (5, None, ""), (6, "​ ", ""), (7, " ", ""), (8, "", ""), (9, "co­coa", ""), (9, "co­coa", ""),
            (10, "x " * 300_000, ""), (11, "x " * 300_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, look string")
    c = look_classes(df, F.col("doc_id"), F.col("text"))
    assert sorted((r.id_a, r.id_b) for r in look_pairs(c).collect()) == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9), (10, 11)]
    assert {r.id for r in look_groups(c).collect()} == {1, 2, 3, 9, 10, 11}
    out = {r.id: r.form for r in unified_forms(df, F.col("doc_id"), F.col("text")).collect()}
    assert out[2] == "cocoa" and out[5] is None and out[8] == ""
    assert look_pairs(look_classes(df.limit(0), F.col("doc_id"), F.col("text"))).count() == 0
