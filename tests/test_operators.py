import json
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import terms, text, tokens
from docweave.operators import batching, guards, jobs, layout, model, render
from docweave.sources import library
from docweave.streaming import qa


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").orderBy("k").select(f(F.col("v")).alias("x")).collect()]


REPAIRED = ["ﬁne ﬂow", "20\x01C and \x01F", "a ð b Þ ¼ þ 1⁄2", "x ¼ Þ5", "5 mÞ2", "a\x02b", "", None]


def repaired(t):
    n = 0
    for pattern, by in text.SYMBOL_REPAIRS:
        t, k = re.subn(pattern, by.replace("$1", r"\1"), t)
        n += k
    return t, n


def test_symbol_repairs_equal_python(spark):
    got = column(spark, REPAIRED, text.repair_symbols)
    assert [None if v is None else tuple(g) for v, g in zip(REPAIRED, got)] == [None if v is None else repaired(v) for v in REPAIRED]


def test_boundary_is_ascii(spark):
    t = terms.terms_of(["le"])
    assert column(spark, ["le élé le漢 xle", "LE le_"], lambda c: F.coalesce(terms.term_counts(c, t)["le"], F.lit(0))) == [2, 1]


def test_protect_restores_canonical_spelling(spark):
    t = terms.terms_of(["heat flow", "heat", "GPS"])
    safe = column(spark, ["Heat flow and HEAT, gps GPS"], lambda c: terms.protect(c, t))
    assert safe == ["{v1000000} and {v1000001}, gps {v1000002}"]
    assert column(spark, safe, lambda c: terms.restore(c, t)) == ["heat flow and heat, gps GPS"]
    with pytest.raises(Exception, match="token already"):
        column(spark, ["{v1000000}"], lambda c: terms.protect(c, t))


def test_terms_are_rejoined(spark):
    assert column(spark, ["SPECTRO- METRY and spec trometry"], lambda c: terms.normalize(c, terms.terms_of(["spectrometry"]))) == ["spectrometry and spectrometry"]


def test_glossary_errors(spark):
    with pytest.raises(Exception, match="line 1"):
        terms.parse_glossary(spark.createDataFrame([(1, "| banned")], "line_no int, line string")).collect()


def test_squash_and_escape(spark):
    assert column(spark, ["Ａb{v12}<i>Ç 9</i>"], text.squash) == ["ab" + re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKC", "Ç 9").lower())]
    assert column(spark, ["<a & 'b' \"c\">"], text.escape_html) == ["&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;"]
    assert column(spark, [bytearray(range(256)) * 2], text.inline_jpeg, "binary")[0].count("\n") == 0
    assert column(spark, ["a b/c", "--", None], text.slug) == ["a-b-c", "paper", "paper"]


def folded(lengths, most=2500):
    out, size, batch = [], 0, 0
    for n in lengths:
        if size and size + n > most:
            size, batch = 0, batch + 1
        size += n
        out.append(batch)
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=40))
def test_greedy_batches_equal_a_loop(spark, lengths):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate([2500, 1, 3000, 0, *lengths])], "g int, k int, n int")
    got = [r["batch"] for r in batching.greedy_batches(rows, "g", "k", "n").orderBy("k").collect()]
    assert got == folded([2500, 1, 3000, 0, *lengths])


GUARDED = [
    ("It has 3 parts.", "它有3個部分。", "en", "zh-TW", True),
    ("It has 3 parts.", "它有4個部分。", "en", "zh-TW", False),
    ("One of two ways {v1}", "1 of 2 {v1}", "en", "ja", True),
    ("first first", "1 1 1", "en", "ko", False),
    ("eins 1", "eins 1 2", "de", "fr", False),
    ("the heat flow", "the warm flow", "en", "fr", False),
    ("heat heat", "heat", "en", "fr", False),
    ("We show this.", "We show this.", "en", "zh-TW", False),
    ("a" * 50, "a" * 50, "de", "fr", False),
    ("a" * 50, "b" * 50, "de", "fr", True),
    ("a" * 50, "カタカナカタ漢", "de", "zh-CN", False),
    ("<style id='1'>x</style>", "<style id='1'>y</style>", "en", "fr", True),
]


def test_guards(spark):
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(GUARDED)], "k int, s string, r string, a string, b string, ok boolean")
    t = terms.terms_of(["heat"], {"heat": ("warm",)})
    got = rows.select("k", "ok", guards.guard(F.col("s"), F.col("r"), F.col("a"), F.col("b"), t).alias("g")).orderBy("k").collect()
    assert [(r["k"], r["g"]["ok"]) for r in got] == [(r["k"], r["ok"]) for r in got]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["1", "2.5", "{v3}", "x"]), max_size=8), st.lists(st.sampled_from(["1", "2.5", "{v3}"]), max_size=8))
def test_multiset_difference(spark, a, b):
    from collections import Counter

    row = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string").select(tokens.minus(tokens.multiset(F.col("a")), tokens.multiset(F.col("b"))).alias("m")).first()
    assert row["m"] == dict(Counter(x for x in a if x != "x") - Counter(b))


def test_layout(spark):
    spans = spark.createDataFrame(
        [
            (1, 1, 1, 72.0, 100.0, 300.0, 115.0, 10.0, "body text that is long."),
            (1, 2, 1, 72.0, 200.0, 300.0, 215.0, 12.0, "A title"),
            (1, 3, 1, 320.0, 100.0, 560.0, 115.0, 6.0, "small"),
            (1, 4, 1, 320.0, 300.0, 560.0, 315.0, 10.0, "3. RÉFÉRENCES"),
            (1, 5, 1, 320.0, 400.0, 560.0, 415.0, 10.0, "Smith 1999 cited"),
            (1, 6, 1, 72.0, 600.0, 300.0, 615.0, 10.0, "Fig. 3 a caption"),
            (1, 7, 2, 72.0, 100.0, 300.0, 115.0, 10.0, "later page"),
            (1, 8, 1, 72.0, 640.0, 300.0, 655.0, 10.0, "  "),
        ],
        "doc_id int, block_no int, page_no int, x0 double, y0 double, x1 double, y1 double, size double, text string",
    )
    kept = layout.paragraphs(spans, layout.references_heading(spans)).orderBy("id").collect()
    assert [(r["id"], r["block_no"], r["label"]) for r in kept] == [(0, 1, "text"), (1, 2, "title"), (2, 6, "caption"), (3, 3, "figure_text"), (4, 4, "title")]
    lines = spark.createDataFrame([(["an iso-", "tope of", "long-", "term use-", "Upper"], ["long-term"])], "l array<string>, c array<string>")
    assert lines.select(layout.joined_lines(F.col("l"), F.col("c"))).first()[0] == "an isotope of long-term use- Upper"


def test_failing_batches_are_retried_by_row(spark):
    def connect():
        def client(system, user):
            rows = json.loads(user)
            if any("bad" in r["input"] for r in rows):
                return "sorry"
            return "```" + json.dumps([{"id": r["id"], "output": r["input"].upper()} for r in rows]) + " done"

        return client

    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "bad"), (2, 3, "c")], "batch int, id int, input string")
    got = {r["id"]: (r["output"], r["error"]) for r in model.translate(rows, connect, "", ["batch"]).collect()}
    assert got == {1: ("A", None), 2: ("", "error: no array"), 3: ("C", None)}


def test_pages_and_jobs(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, "title", "T & U", "passed"), (1, 1, 1, "text", "", "error: x"), (1, 1, 2, "figure_text", "f", None), (1, 2, 3, "text", "p", "failed: <y>")], "doc_id int, page_no int, id int, label string, output string, checks string")
    html = {r["page_no"]: r["html"] for r in render.page_sections(rows.withColumn("ref", F.lit(2)), ["doc_id"], references_page="ref").collect()}
    assert html[1] == '<section id="page-1"><h2>T &amp; U</h2><p><em>no text</em><span class="warn">error: x</span></p><details><summary>1</summary><table><tr><td>f</td></tr></table></details></section>'
    assert html[2] == '<section id="page-2"><p>p<span class="warn">failed: &lt;y&gt;</span></p><p>References</p></section>'
    histogram = jobs.check_histogram(rows)
    assert jobs.manifest(spark, {"b": 1, "a": 2}, histogram.where("status is not null")).first()["checks"] == {"error": 1, "failed": 1, "passed": 1}
    assert jobs.config_hash({"a": 2, "b": 1}) == jobs.config_hash({"b": 1, "a": 2})
    first = jobs.publish(rows, f"file://{tmp_path}", "x", {"a": 1})
    assert first == jobs.publish(rows.limit(0), f"file://{tmp_path}", "x", {"a": 1})
    assert spark.read.parquet(first).count() == 4


def test_library(spark):
    for spec, n in (("3-1", 5), ("0", 5), ("6", 5), ("x", 5), ("", 5)):
        with pytest.raises(Exception, match="no such pages"):
            spark.createDataFrame([(spec, n)], "s string, n int").select(library.page_numbers(F.col("s"), F.col("n"))).collect()
    assert column(spark, ["file:///a%20b+c", "file://localhost/x", "http://h/x", "file:///x?q"], library.local_path) == ["/a b+c", "/x", None, None]
    assert column(spark, ["abcd2345"], library.item_key) == ["ABCD2345"]
    with pytest.raises(Exception, match="not an item key"):
        column(spark, ["abc"], library.item_key)


def test_questions(spark, tmp_path):
    history = spark.createDataFrame([(1, k, f"q{k}", f"a{k}") for k in range(5)], "job_id int, seq int, question string, answer string")
    pages = spark.createDataFrame([(1, 1, "o1", "t1"), (1, 2, "o2", "t2")], "job_id int, page_no int, original string, output string")
    asked = spark.createDataFrame([(1, "one?", 2, False), (1, "all?", 2, True)], "job_id int, question string, page_no int, full boolean")
    got = {r["question"]: r["context"] for r in qa.contexts(asked, pages, history).collect()}
    said = "q2\na2\n\nq3\na3\n\nq4\na4"
    assert got == {"one?": f"o2\n\nt2\n\n{said}\n\none?", "all?": f"o1\n\nt1\n\no2\n\nt2\n\n{said}\n\nall?"}
    history.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(history.schema).parquet(f"{tmp_path}/in")
    qa.append_history(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
