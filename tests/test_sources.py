"""File formats, written and read again."""

from lodestone import sources as S


def test_jsonl_and_json(spark, tmp_path):
    good = spark.createDataFrame([("n1", "p", "q?", "a.")], "nugget_id string, paper_id string, question string, answer string")
    bad = spark.createDataFrame([("n2", "p", "q?", None)], good.schema)
    path = str(tmp_path / "n")
    S.write_jsonl(good, path, bad)
    assert [r.nugget_id for r in S.read_jsonl(spark, path).collect()] == ["n1"]
    assert S.read_jsonl(spark, path, removed=True).count() == 2 and S.jsonl_count(spark, path) == 2
    (tmp_path / "m.json").write_text('[{"paper_id": "x", "authors": ["A", "B"], "year": 2020}]')
    assert S.read_json(spark, str(tmp_path / "m.json")).first().authors == ["A", "B"]
    S.write_json(good, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_reference_export(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1|2001.1|A title|2020\nshort|line\n2||B|soon\n")
    rows = S.read_reference_export(spark, str(tmp_path / "e.txt")).collect()
    assert [(r.item_id, r.arxiv_id, r.year) for r in rows] == [("1", "2001.1", 2020), ("2", None, None)]


def test_citations(spark, tmp_path):
    raw = spark.createDataFrame([("A, title!", "", "2020", "v", "x.pdf"), ("a title", "Me", "", "", "y.pdf")], "title string, authors string, year string, venue string, source_pdf string")
    S.write_citations(raw, str(tmp_path / "c"))
    r = S.read_citations(spark, str(tmp_path / "c")).first()
    assert (r.authors, r.year, r.occurrence_count, r.source_pdfs) == ("Me", "2020", 2, "x.pdf;y.pdf")


def test_pdf_names(spark, tmp_path):
    for n in ("Smith and Lee - 2020 - A Title.pdf", "Only title.pdf", "Doe - Work.pdf"):
        (tmp_path / n).write_bytes(b"%PDF-1.4")
    got = {(r.authors, r.year, r.title) for r in S.read_pdf_names(spark, str(tmp_path)).collect()}
    assert got == {("Smith and Lee", 2020, "A Title"), (None, None, "Only title"), ("Doe", None, "Work")}


def test_atom(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<feed><entry><id>http://x/abs/2001.00001v2</id><title>A\n b</title><author><name>N. One</name></author>"
        "<author><name>T. Two</name></author><published>2020-01-02T00:00:00Z</published><summary> s </summary></entry></feed>"
    )
    r = S.read_atom(spark, str(tmp_path / "f.xml")).first()
    assert (r.arxiv_id, r.title, r.authors, str(r.published), r.abstract) == ("2001.00001", "A b", ["N. One", "T. Two"], "2020-01-02", "s")


def test_trace(spark, tmp_path):
    t = spark.createDataFrame([("t", "q", "m", 0.1, [(str(i), 1.0) for i in range(40)])], "ts string, query string, mode string, elapsed_s double, top_nuggets array<struct<nugget_id:string,score:double>>")
    S.append_trace(t, str(tmp_path / "t"))
    S.append_trace(t, str(tmp_path / "t"))
    rows = spark.read.json(str(tmp_path / "t")).collect()
    assert len(rows) == 2 and len(rows[0].top_nuggets) == 30
