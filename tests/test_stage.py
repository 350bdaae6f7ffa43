import json
import subprocess
import sys
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from shutil import which

import pytest
from pyspark.sql import functions as F

from docweave import __main__ as command
from docweave.functions import script, terms
from docweave.operators import audit, clients, model, references, replies, translate
from docweave.sources import pdf, rest
from docweave.streaming import service

TERMS = terms.terms_of(["heat"])


def client(failing=(), review_fails=()):
    """Upper-cases inputs; calls with a text of failing, or reviews with one of review_fails, are answered without an array."""

    def connect():
        def chat(system, user):
            asked = json.loads(user)
            if isinstance(asked, dict):
                if any(r["input"] in review_fails for r in asked["original"]):
                    return "sorry"
                return json.dumps([{"id": r["id"], "output": r["output"] + "!"} for r in asked["draft"]])
            if any(r["input"] in failing for r in asked):
                return "sorry"
            return "```json\n" + json.dumps([{"id": r["id"], "output": r["input"].upper().replace("{V", "{v")} for r in asked]) + "\n``` done"

        return chat

    return connect


def staged(spark, connect, **options):
    rows = [(1, 1, "a Heat b"), (1, 2, "bad"), (2, 3, "worse"), (2, 4, "x {v1000000}"), (3, 5, None), (4, 6, "12 a")]
    source = spark.createDataFrame(rows, "batch int, id int, source string").withColumn("extra", F.lit("kept"))
    found = translate.translated(source, connect, ["batch"], TERMS, "de", "fr", **options).collect()
    assert {r["extra"] for r in found} == {"kept"}
    return {r["id"]: (r["draft"], r["revised"], r["output"], r["checks"]) for r in found}


def test_translation_stage(spark):
    got = staged(spark, client(failing=("bad",), review_fails=("worse",)))
    assert got[1] == ("A heat B", "A heat B!", "A heat B!", "passed")
    assert got[2] == (None, None, "", "error: no array")
    assert got[3] == ("WORSE", None, "", "error: no array")
    assert got[4][2:] == ("", "error: the text has a glossary token already")
    assert got[5][2:] == ("!", "passed") and got[6][2:] == ("12 A!", "passed")
    assert staged(spark, client(review_fails=("worse",)), lenient=True)[3] == ("WORSE", None, "WORSE", "error: no array")
    assert staged(spark, client(), review=False)[1] == ("A heat B", None, "A heat B", "passed")
    wrong = staged(spark, lambda: lambda s, u: json.dumps([{"id": r["id"], "output": "13"} for r in json.loads(u)]), review=False)
    assert wrong[6][3] == "failed: numbers, tags or placeholders differ"


def test_gates(spark):
    rows = spark.createDataFrame([(1, "x", "passed"), (2, "", "error: y"), (2, "z", "failed: w"), (3, "", "not translated"), (4, "", None)], "batch int, output string, checks string")
    assert tuple(audit.failed_batches(rows, "batch").first()) == (1, [2])
    assert tuple(audit.gates(rows.limit(0)).first()) == (False, False)
    audit.required(rows, lenient=True)
    for some, told in ((rows, "failed their checks"), (rows.where("output = ''"), "nothing was")):
        with pytest.raises(RuntimeError, match=told):
            audit.required(some)
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r[0] for r in audit.missing_files(names("a", "b", "b"), names("a")).collect()] == ["b"]
    for bad in (("en", "en"), ("de", "fr", "pdf"), ("en", "zh-TW", "pages", True), ("en", "zh-TW", "pages", False, "command", "h")):
        with pytest.raises(ValueError):
            audit.legal_options(*bad)
    audit.legal_options("en", "zh-TW", "pdf", True)


def test_script_equals_icu(spark):
    if not which("uconv"):
        pytest.skip("no uconv")
    for target, transform in script.CONVERSIONS.items():
        own = [chr(c) for c in range(*script.HAN)]
        made = subprocess.run(["uconv", "-f", "UTF-8", "-t", "UTF-8", "-x", transform], input="\n".join(own), text=True, capture_output=True, check=True).stdout.split("\n")
        got = spark.createDataFrame([("\n".join(own),)], "t string").select(script.convert_script(F.col("t"), target)).first()[0].split("\n")
        # the ICU that Spark ships is newer than some systems' and knows more characters; what both convert, they convert alike
        assert [(o, a, b) for o, a, b in zip(own, got, made, strict=True) if a != b and b != o] == []
        assert sum(a != b for a, b in zip(got, own, strict=True)) > 1000


def test_containing_equals_substring_search(spark):
    long = "".join(chr(97 + k * k * 7 % 26) + str(k % 10) for k in range(5000))
    sections = {1: long, 2: "short", 3: "", 4: "abcdefghijkl", 5: long[4000:4200]}
    keys = ["abcdefghijkl", long[4050:4110], long[8180:8210], long[-12:], long[:60], "notthereatall", long[10:22] + "zzzz", None]
    got = references.containing(spark.createDataFrame([(k,) for k in keys * 2], "k string"), spark.createDataFrame(list(sections.items()), "section int, text string"), "section").collect()
    assert sorted(map(tuple, got)) == sorted({(k, n) for k in keys if k for n, t in sections.items() if k in t})


def test_strict_batches(spark):
    cases = {"[1": "no array", '[{"id": 1, "output": "a"}]': "another number of rows", '[{"id": 1, "output": "a"}, {"id": 1, "output": "b"}]': "repeated ids", '[{"id": 1, "output": "a"}, {"id": 3, "output": "b"}]': "other ids", '[{"id": 2, "output": "a"}, {"id": 1, "output": "b"}]': None, '[{"id": 2, "input": "a"}, {"id": 1, "output": "b"}]': "other keys"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", replies.strict_error(F.col("t"), F.array(F.lit(1), F.lit(2)))).collect()}
    assert got == cases


def serving(answer):
    """A server on a free port whose answer(path, body) gives the code and the JSON to send."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            code, body = answer(self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        do_POST = do_GET

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def test_http_client():
    def answer(path, body):
        asked = json.loads(body)
        assert path == "/v1/chat/completions" and asked["temperature"] == 0
        text = asked["messages"][1]["content"]
        return (500, {}) if text == "down" else (200, {"choices": [{"finish_reason": "length" if text == "long" else "stop", "message": {"content": f" {text} "}}]})

    server = serving(answer)
    chat = clients.connect_to({"engine": "http", "endpoint": f"http://127.0.0.1:{server.server_port}/v1/", "model": "m", "per_second": 100})()
    assert chat("s", "hello") == "hello"
    with pytest.raises(ValueError, match="length"):
        chat("s", "long")
    with pytest.raises(RuntimeError, match="no answer"):
        chat("s", "down")
    server.shutdown()
    for url in ("https://127.0.0.1:1/v1", "http://example.org:1/v1", "http://127.0.0.1/v1", "http://u:p@127.0.0.1:1/v1", "http://127.0.0.1:1/v2", "http://127.0.0.1:1/v1?q", "http://127.0.0.1:x/v1"):
        with pytest.raises(ValueError):
            clients.valid_endpoint(url)


def test_command_client(monkeypatch):
    monkeypatch.setenv("SOME_API_KEY", "k")
    shown = "import os, sys; t = sys.stdin.read(); print(t.upper(), os.environ.get('SOME_API_KEY'), os.listdir('.'))"
    chat = clients.connect_to({"engine": "command", "command": [sys.executable, "-c", shown]})()
    assert chat("s", "u") == "S\n\nU None []"
    with pytest.raises(RuntimeError, match="failed"):
        clients.connect_to({"engine": "command", "command": [sys.executable, "-c", "raise SystemExit(1)"]})()("s", "u")
    with pytest.raises(ValueError):
        clients.connect_to({"engine": "other"})


def test_library_source(spark):
    def answer(path, body):
        start = int(path.rpartition("start=")[2])
        return (200, [{"key": k} for k in range(start, min(start + 100, 230))]) if path.startswith("/items") else (404, {})

    server = serving(answer)
    spark.dataSource.register(rest.LibrarySource)
    url = f"http://127.0.0.1:{server.server_port}"
    found = spark.read.format("library").option("url", url).option("route", "items").load()
    assert sorted(json.loads(r["value"])["key"] for r in found.collect()) == list(range(230))
    with pytest.raises(RuntimeError, match="no such item"):
        rest.fetch(f"{url}/other?start=0")
    server.shutdown()
    server.server_close()
    with pytest.raises(RuntimeError, match="not running"):
        rest.fetch(f"{url}/items?start=0")


def test_question_service(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "original", "output"), (2, 9, "other", "job")], "job_id long, page_no int, original string, output string")
    own = service.Service(spark, 1, pages, f"file://{tmp_path}/qa", lambda: lambda s, u: f"<{u}>", "page {token}")
    server = own.server()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None, **headers):
        data = body if body is None or isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, data, headers), timeout=60) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    token = {"X-Token": own.token}
    assert call("/") == (200, f"page {own.token}")
    assert call("/none")[0] == 404 and call("/", Host="elsewhere")[0] == 403
    assert call("/api/qa") == (200, "[]")
    assert call("/api/ask", {"question": "q", "page": 1})[0] == 403
    assert call("/api/ask", b"x" * (service.MOST + 1), **token)[0] == 413
    for bad in ({"question": " ", "page": 1}, {"question": "q", "page": 9}, {"page": 1}, [], b"{"):
        assert call("/api/ask", bad, **token)[0] == 400
    code, body = call("/api/ask", {"question": "why?", "page": 1}, **token)
    assert code == 200 and json.loads(body)["answer"] == "<original\n\noutput\n\nwhy?>"
    assert "why?\n<original" in json.loads(call("/api/ask", {"question": "and?", "page": 1}, **token)[1])["answer"]
    assert [(r["seq"], r["question"]) for r in json.loads(call("/api/qa")[1])] == [(1, "why?"), (2, "and?")]
    server.shutdown()
    server.server_close()


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"no")
    got = {r["path"].rpartition("/")[2]: r["problem"] for r in pdf.preflight(pdf.files_of(spark, f"file://{tmp_path}")).collect()}
    assert got == {"a.pdf": None, "b.pdf": "not a PDF"}
    try:
        import pymupdf  # noqa: F401
    except ImportError:
        with pytest.raises(Exception, match="needs the pymupdf library"):
            pdf.spans_of(pdf.files_of(spark, f"file://{tmp_path}")).collect()


def test_command_line(spark, tmp_path, capsys):
    assert command.main(["list"]) == 0 and "greedy_batches" in capsys.readouterr().out
    assert command.main(["doctor"]) == 0 and "pyspark found" in capsys.readouterr().out
    assert command.main(["run", "page_spec", "/root/testdata/sf0.001", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_echo():
    assert model.ask(model.echo, "", [{"id": 1, "input": "a"}], [1]) == {1: "a"}
    with pytest.raises(ValueError, match="other ids"):
        model.ask(model.echo, "", [{"id": 1, "input": "a"}], [1, 2])
