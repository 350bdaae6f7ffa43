"""Whole papers: blocks of lines, page sections and documents, published jobs, questions, and the checks around them."""

import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from docweave.functions import terms, tokens
from docweave.operators import audit, batching, clients, jobs, layout, model, render, translate
from docweave.plans import catalog
from docweave.sources import library, pdf
from docweave.streaming import qa

LINE = "doc_id int, page_no int, block_no int, line_no int, block_type int, width double, height double, x0 double, y0 double, x1 double, y1 double, size double, text string"


def line(block, n, text, x0=72.0, y0=100.0, size=10.0, kind=0, page=1, width=600.0, height=800.0):
    return (1, page, block, n, kind, width, height, x0, y0 + 15 * n, x0 + 200, y0 + 15 * n + 12, size, text)


def test_blocks(spark):
    rows = [line(1, 0, "long iso-"), line(1, 1, "tope and well-"), line(1, 2, "known words."), line(1, 3, "  "), line(2, 0, "picture", kind=1), line(3, 0, "x", size=7.04), line(3, 1, "wide small text", size=6.96), line(4, 0, " ", size=3.0)]
    spans, known = spark.createDataFrame(rows, LINE), spark.createDataFrame([(1, ["well-known"])], "doc_id int, compounds array<string>")
    got = {r["block_no"]: r for r in layout.blocks(spans, known).collect()}
    assert {k: (r["text"], r["n_lines"], r["size"], r["body_size"]) for k, r in got.items()} == {1: ("long isotope and well-known words.", 3, 10.0, 10.0), 3: ("x wide small text", 2, 7.0, 10.0), 4: ("", 0, 3.0, 10.0)}
    assert (got[1]["y0"], got[1]["y1"], got[1]["x1"]) == (100.0, 157.0, 272.0)
    assert [(r["block_no"], r["label"]) for r in layout.paragraphs(layout.blocks(spans)).orderBy("id").collect()] == [(1, "text"), (3, "figure_text")]


def test_pages_have_their_own_sizes(spark):
    page = {"width": 1000.0, "height": 400.0}
    rows = [line(1, 0, "left of a wide page, " * 8, x0=320.0, y0=30.0, **page), line(2, 0, "right of it", x0=520.0, y0=25.0, **page), line(3, 0, "a running header", y0=10.0, **page), line(4, 0, "small " * 20, size=6.0, y0=200.0, **page)]
    spans = spark.createDataFrame(rows, LINE)
    assert [(r["block_no"], r["checks"]) for r in layout.paragraphs(spans).orderBy("id").collect()] == [(1, None), (4, "not translated"), (2, None)]
    assert [tuple(r) for r in layout.skipped(spans).collect()] == [(1, 1, "running header", "a running header")]
    assert [tuple(r) for r in spans.where("block_no = 2").select(*layout.percent_box()).collect()] == [(52.0, 6.25, 20.0, 3.0)]


def test_sections_of_given_pages(spark):
    rows = spark.createDataFrame([(1, 1, 0, "figure_text", "<a>" * 40, "", "not translated"), (1, 1, 1, "text", "s", "out", "failed: x"), (1, 3, 2, "text", "s", "late", None)], "doc_id int, page_no int, id int, label string, source string, output string, checks string")
    pages = spark.createDataFrame([(1, 1, bytearray(b"\xff" * 90)), (1, 2, None), (1, 3, None), (1, 4, None)], "doc_id int, page_no int, jpeg binary")
    html = {r["page_no"]: r["html"] for r in render.page_sections(rows.withColumn("ref", F.lit(3)), ["doc_id"], references_page="ref", pages=pages).collect()}
    assert html[1].startswith('<section id="page-1"><p>out<span class="warn">failed: x</span></p><details><summary>1</summary><table><tr><td>' + "&lt;a&gt;" * 26 + "&lt;a</td><td><em>see the page</em></td></tr>")
    assert 'src="data:image/jpeg;base64,' in html[1] and "\n" not in html[1]
    assert html[2] == '<section id="page-2"><p>Nothing on this page</p></section>'
    assert html[4] == '<section id="page-4"><p>References</p></section>' and "late</p><p>References" in html[3]
    titles = spark.createDataFrame([(1, "<T>", [("a&b", None)])], "doc_id int, title string, facts array<struct<name:string,value:string>>")
    whole = render.reading_pages(render.page_sections(rows, ["doc_id"], pages=pages), titles, ["doc_id"]).first()["html"]
    assert "<title>&lt;T&gt;</title>" in whole and '<nav><a href="#page-1">1</a><a href="#page-2">2</a>' in whole and "<dt>a&amp;b</dt><dd></dd>" in whole
    assert whole.index('id="page-2"') < whole.index('id="page-3"') and 'data-first="1"' in whole


def test_references_of_documents_without_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, "text", "out")], "doc_id int, page_no int, id int, label string, output string")
    pages = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (2, 1, 2), (2, 2, 2), (3, 9, None)], "doc_id int, page_no int, ref int")
    html = {(r["doc_id"], r["page_no"]): r["html"] for r in render.page_sections(rows, ["doc_id"], references_page="ref", pages=pages).collect()}
    body = {k: v.removeprefix(f'<section id="page-{k[1]}">').removesuffix("</section>") for k, v in html.items()}
    assert body == {(1, 1): "<p>out</p>", (1, 2): "<p>References</p>", (2, 1): "<p>Nothing on this page</p>", (2, 2): "<p>References</p>", (3, 9): "<p>Nothing on this page</p>"}
    # no line of the first document is kept, for none has a word of three letters
    texts = [(1, "\n".join(["St ea."] * 40)), (2, "\n".join(["St ea.", "some words"] * 20))]
    spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.reading_pages(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == con.sql(catalog.ORACLE_SQL["reading_pages"] + " ORDER BY doc_id").fetchall()


def test_rows_left_out_by_rule_are_not_sent(spark):
    rows = spark.createDataFrame([(1, 1, "a", None), (1, 2, "long", "not translated")], "batch int, id int, source string, checks string")
    got = {r["id"]: (r["output"], r["checks"]) for r in translate.translated(rows, lambda: model.echo, ["batch"], [], "de", "fr").collect()}
    assert got == {1: ("a", "passed"), 2: ("", "not translated")}
    assert translate.draft_prompt("en", "zh-TW") != translate.draft_prompt("en", "zh-CN") and "Japanese" in translate.question_prompt("ja")


def test_jobs_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "passed", "d", "r"), (2, "failed: x: y", "d", "r"), (3, "not translated", None, None), (4, None, None, None)], "id int, checks string, draft string, revised string")
    assert [(r["id"], r["kind"], r["reason"]) for r in audit.review_failures(rows).collect()] == [(2, "failed", "x: y")]
    config, root = {"a": 1}, f"file://{tmp_path}"
    facts = jobs.manifest(spark, config, jobs.check_histogram(rows.where("checks is not null")), source="p.pdf", selected_pages=[1, 3], seconds=1.5, references_page=None)
    path = jobs.publish_job({"rows": rows, "manifest": facts}, root, "paper", config)
    assert jobs.publish_job({"rows": rows.limit(0), "manifest": facts}, root, "paper", config) == path
    found = jobs.read_job(spark, path, "rows")
    told = found["manifest"].first()
    assert found["rows"].count() == 4 and (told["source"], told["selected_pages"], told["n_rows"], told["references_page"]) == ("p.pdf", [1, 3], 3, None)
    with pytest.raises(FileNotFoundError):
        jobs.read_job(spark, path, "skipped")
    other = jobs.publish_job({"manifest": facts}, root, "paper", {"a": 2})
    with pytest.raises(ValueError, match="other settings"):
        jobs.read_job(spark, other)


def test_questions_by_id(spark):
    pages = spark.createDataFrame([(1, 1, "o1", "t1"), (1, 2, "o2", "t2")], "job_id int, page_no int, original string, output string")
    history = spark.createDataFrame([], "job_id int, seq int, question string, answer string")
    asked = spark.createDataFrame([(1, "same?", 1, False), (1, "same?", 2, False), (1, "gone?", 9, False)], "job_id int, question string, page_no int, full boolean")
    assert sorted(r["context"] for r in qa.contexts(asked, pages, history).collect()) == ["o1\n\nt1\n\nsame?", "o2\n\nt2\n\nsame?"]
    picked = asked.limit(1).withColumns({"question_id": F.lit("q"), "picked": F.lit("this one")})
    assert [(r["question_id"], r["context"]) for r in qa.contexts(picked, pages, history).collect()] == [("q", "o1\n\nt1\n\nthis one\n\nsame?")]


def test_pdf_checks(spark):
    rows = [("a", b"%PDF-1 /Encrypt 3 0 R", 1), ("b", b"%PDF-1 /Encrypt<< >>", 1), ("c", b"%PDF-1 /EncryptMetadata", 1), ("d", b"%PDF-1", 0), ("e", b"%PDF-1", None), ("f", None, None)]
    files = spark.createDataFrame([(p, c and bytearray(c), n) for p, c, n in rows], "path string, content binary, page_count int")
    assert {r["path"]: r["problem"] for r in pdf.preflight(files).collect()} == {"a": "encrypted", "b": "encrypted", "c": None, "d": "no pages", "e": "unopenable", "f": "empty file"}
    pages = spark.createDataFrame([(1, 1, "x" * 30), (1, 2, " " * 50)], "doc_id int, page_no int, text string")
    pdf.required_text(pages.where("page_no = 1"), ["doc_id"])
    with pytest.raises(RuntimeError, match=r"\[2\]"):
        pdf.required_text(pages, ["doc_id"])
    made = [(2, 2, "漢", "/out/a", False), (2, 3, "漢", "/out/a", False), (2, 2, "a", "/out/a", False), (2, 2, "漢", "/else/a", False), (2, 2, "漢", "/out/a", True), (2, 2, "漢", "/out/../a", False)]
    frame = spark.createDataFrame(made, "s int, o int, t string, p string, e boolean")
    told = [r[0] for r in frame.select(pdf.output_problem(F.col("s"), F.col("o"), F.col("t"), F.col("p"), "/out/", F.col("e"))).collect()]
    assert told == [None, "another number of pages", "nothing translated", "outside the output folder", "encrypted", "outside the output folder"]


def test_attachments(spark):
    items = spark.createDataFrame([("P", None, None, None), ("A", "P", "application/pdf", "a.pdf"), ("B", "P", "text/html", "b"), ("C", "P", "application/pdf", "c.pdf"), ("S", None, "application/pdf", "s.pdf"), ("E", None, None, None)], "key string, parent string, content_type string, filename string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert sorted((r["asked"], r["filename"]) for r in library.attachments(items, keys("P", "B")).collect()) == [("B", "a.pdf"), ("B", "c.pdf"), ("P", "a.pdf"), ("P", "c.pdf")]
    assert {r["asked"]: r["n"] for r in library.attachment_sets(items, keys("P", "A", "E")).collect()} == {"P": 2, "A": 2, "E": 0}
    with pytest.raises(Exception, match="belongs to no item: S"):
        library.attachments(items, keys("S")).collect()


def test_finished_answers():
    assert clients.finished({"choices": [{"finish_reason": "stop", "message": {"content": " x "}}]}) == "x"
    for told, error in (({"choices": [{"finish_reason": "length", "message": {"content": "x"}}]}, ValueError), ({"choices": [{"finish_reason": "stop", "message": {"content": " "}}]}, ValueError), ({"choices": []}, RuntimeError), ([], RuntimeError), (None, RuntimeError)):
        with pytest.raises(error):
            clients.finished(told)


def test_many_tokens_are_counted_in_linear_time(spark):
    many = " ".join(str(k % 16_000) for k in range(64_000))
    frame = spark.createDataFrame([(many,), ("",), (None,), ("7 7 {v1} 7",)], "t string").select("t", tokens.multiset(F.col("t")).alias("m"))
    began = time.perf_counter()
    got = {r["t"]: r["m"] for r in frame.collect()}
    assert time.perf_counter() - began < 15
    assert got[many] == dict(Counter(many.split())) and got[""] == {} and got[None] is None and got["7 7 {v1} 7"] == {"7": 3, "{v1}": 1}


def test_batches_of_long_groups(spark):
    rows = spark.range(200_000).selectExpr("id % 3 as g", "id as k", "cast(id % 900 as int) as n").union(spark.sql("select null, 1L, null"))
    got = batching.greedy_batches(rows, "g", "k", "n").orderBy("g", "k").collect()
    own, size, batch = object(), 0, 0
    for r in got:
        if r["g"] != own:
            own, size, batch = r["g"], 0, 0
        if size and size + (r["n"] or 0) > 2500:
            size, batch = 0, batch + 1
        size += r["n"] or 0
        assert r["batch"] == batch
    assert len(got) == 200_001


def test_terms_of_several_words(spark):
    t = terms.terms_of(["heat flow", "heat", "C++", "GPS", "é"])
    text = "Heat flow, heat-flow HEAT heated C++ gps GPS é caffé x"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(terms.term_counts(F.col("t"), t).alias("c"), terms.protect(F.col("t"), t).alias("p")).collect()
    assert got[0]["c"] == {"heat flow": 1, "heat": 3, "GPS": 1} and got[1]["c"] == {} and got[1]["p"] is None
    assert got[0]["p"] == "{v1000000}, {v1000001}-flow {v1000001} heated C++ gps {v1000003} é caffé x"
