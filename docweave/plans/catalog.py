"""The registered queries of the engine and, where DuckDB can express it, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import script, terms, text, tokens
from docweave.operators import audit, batching, guards, jobs, layout, model, references, render, replies, translate
from docweave.sources import library, pdf
from docweave.streaming import qa

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

GLOSSARY = terms.terms_of(["the", "heat", "tion", "on the", "AND", "que"], {"heat": ("warmth",)})


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return found.withColumn("line", F.trim("line")).where("line <> ''")


LINES = """lines AS (
  SELECT doc_id, source, n - 1 AS line_no, trim(l) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
  WHERE trim(l) <> '')"""

SPANS = """every AS (
  SELECT doc_id, n AS block_no, CASE WHEN n % 13 = 12 THEN 1 ELSE 0 END AS block_type, n // 12 + 1 AS page_no, CASE WHEN doc_id % 7 = 3 THEN 1000.0 ELSE 595.0 END AS width, CASE WHEN doc_id % 7 = 3 THEN 400.0 ELSE 842.0 END AS height, CASE WHEN n % 5 = 3 THEN 320.0 ELSE 72.0 END AS x0, (40 + (n % 12) * 60)::DOUBLE AS y0,
         CASE WHEN n % 11 = 10 THEN CASE WHEN n % 5 = 3 THEN 335.0 ELSE 85.0 END WHEN n % 5 = 3 THEN 560.0 ELSE 300.0 END AS x1,
         (55 + (n % 12) * 60)::DOUBLE AS y1, CASE n % 7 WHEN 6 THEN 6.0 WHEN 0 THEN 12.0 ELSE 10.0 END AS size, l AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)),
spans AS (SELECT * FROM every WHERE block_type = 0),
body AS (
  SELECT doc_id, size AS body_size FROM (
    SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY sum(length(trim(text))) DESC, min(page_no * 100000 + block_no)) AS r
    FROM spans GROUP BY doc_id, size) WHERE r = 1),
told AS (
  SELECT s.*, body_size, CASE WHEN x1 - x0 < 20 THEN 'narrow margin text' WHEN NOT regexp_matches(text, '\\p{L}{3}') THEN 'no words'
           WHEN y1 < height * 0.085 THEN 'running header' END AS reason,
         CASE WHEN regexp_matches(text, '^(Fig\\.|Figure|Figura|Abb\\.|Abbildung|Table|Tab\\.|Tabelle|Tabla|Tableau|図|表|그림|표)\\s*\\d') THEN 'caption'
           WHEN size < 0.75 * body_size AND body_size <> 0 THEN 'figure_text'
           WHEN length(text) < 120 AND NOT regexp_matches(text, '[.,;:。，；：、]$') AND size >= 0.95 * body_size THEN 'title' ELSE 'text' END AS label
  FROM spans s JOIN body USING (doc_id) WHERE trim(text) <> '')""".replace("\\\\", "\\")

KEPT = """kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, x0 > width / 2, y0, block_no) - 1 AS id FROM told WHERE reason IS NULL)"""

BATCHES = """RECURSIVE counted AS (SELECT doc_id, line_no, length(line) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM lines),
folded AS (
  SELECT doc_id, line_no, l, k, l AS size, 0 AS batch FROM counted WHERE k = 1
  UNION ALL
  SELECT c.doc_id, c.line_no, c.l, c.k, CASE WHEN f.size > 0 AND f.size + c.l > 2500 THEN c.l ELSE f.size + c.l END,
         f.batch + CASE WHEN f.size > 0 AND f.size + c.l > 2500 THEN 1 ELSE 0 END
  FROM folded f JOIN counted c ON c.doc_id = f.doc_id AND c.k = f.k + 1)"""


def with_recursive(body: str) -> str:
    return f"WITH RECURSIVE {LINES}, {BATCHES.removeprefix('RECURSIVE ')} {body}"


@query(f"WITH {LINES} SELECT doc_id, line_no::BIGINT AS line_no, line FROM lines")
def doc_lines(spark, sf_dir):
    return lines_of(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def _batches(spark, sf_dir):
    lines = lines_of(spark, sf_dir).select("doc_id", "line_no", F.length("line").alias("n_chars"))
    return batching.greedy_batches(lines, "doc_id", "line_no", "n_chars")


@query(with_recursive("SELECT doc_id, line_no::BIGINT AS line_no, l::BIGINT AS n_chars, batch::BIGINT AS batch FROM folded"))
def greedy_batches(spark, sf_dir):
    return _batches(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "n_chars", F.col("batch").cast("long").alias("batch"))


@query(with_recursive(""", sizes AS (SELECT doc_id, batch, sum(l) AS chars, count(*) AS n FROM folded GROUP BY doc_id, batch)
SELECT source, count(*)::BIGINT AS n_batches, sum(n)::BIGINT AS n_lines, max(chars)::BIGINT AS largest, count(*) FILTER (chars > 2500)::BIGINT AS oversize
FROM sizes JOIN documents USING (doc_id) GROUP BY source"""))
def batch_statistics(spark, sf_dir):
    sizes = _batches(spark, sf_dir).groupBy("doc_id", "batch").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n"))
    by = sizes.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source")
    return by.agg(F.count("*").alias("n_batches"), F.sum("n").alias("n_lines"), F.max("chars").alias("largest"), F.count_if(F.col("chars") > 2500).alias("oversize"))


def _count_sql(t: terms.Term) -> str:
    flag = "" if t.acronym else "(?i)"
    return f"SELECT doc_id, '{t.text}' AS term, len(regexp_extract_all(regexp_replace(text, '<[^>]+>', '', 'g'), '{flag}\\b{t.text}\\b'))::BIGINT AS n FROM documents"


@query("SELECT * FROM (" + " UNION ALL ".join(map(_count_sql, GLOSSARY)) + ") WHERE n > 0")
def term_counts(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(terms.term_counts(F.col("text"), GLOSSARY)).alias("term", "n"))
    return found.withColumn("n", F.col("n").cast("long"))


def _protect_sql() -> str:
    c = "text"
    for t in terms.longest_first(GLOSSARY):
        c = f"regexp_replace({c}, '\\b{t.text}\\b', '{t.token}', '{'g' if t.acronym else 'gi'}')"
    restored = "protected"
    for t in GLOSSARY:
        restored = f"replace({restored}, '{t.token}', '{t.text}')"
    return f"SELECT doc_id, sha256(protected) AS protected, sha256({restored}) AS restored FROM (SELECT doc_id, {c} AS protected FROM documents)"


@query(_protect_sql())
def protect_restore(spark, sf_dir):
    safe = table(spark, sf_dir, "documents").select("doc_id", terms.protect(F.col("text"), GLOSSARY).alias("p"))
    return safe.select("doc_id", F.sha2("p", 256).alias("protected"), F.sha2(terms.restore(F.col("p"), GLOSSARY), 256).alias("restored"))


SQUASHED = r"regexp_replace(lower(regexp_replace(text, '\{v[0-9]+\}|<[^>]+>', ' ', 'g')), '[^a-z0-9]', '', 'g')"


@query(f"SELECT doc_id, length({SQUASHED})::BIGINT AS n_chars, sha256({SQUASHED}) AS digest FROM documents")
def squash_text(spark, sf_dir):
    plain = table(spark, sf_dir, "documents").select("doc_id", text.squash(F.col("text")).alias("s"))
    return plain.select("doc_id", F.length("s").cast("long").alias("n_chars"), F.sha2("s", 256).alias("digest"))


@query(r"""SELECT doc_id, letters, dense, dense >= 15 OR letters - dense >= 40 AS prose FROM (
  SELECT doc_id, len(regexp_extract_all(text, '\p{L}'))::BIGINT AS letters, len(regexp_extract_all(text, '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]'))::BIGINT AS dense FROM documents)""")
def letter_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("letters"), text.dense_letters(F.col("text")).cast("long").alias("dense"), text.is_prose(F.col("text")).alias("prose"))


def _spans(spark, sf_dir):
    return layout.text_blocks(layout.document_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(f"WITH {SPANS} SELECT doc_id, body_size FROM body")
def body_size(spark, sf_dir):
    return layout.dominant_size(_spans(spark, sf_dir), ["doc_id"], ["page_no", "block_no"])


def _told(spark, sf_dir):
    return layout.told(_spans(spark, sf_dir))


@query(f"WITH {SPANS} SELECT doc_id, block_no::BIGINT AS block_no, label, (y0 * 1000)::BIGINT AS y_milli FROM told WHERE reason IS NULL")
def block_labels(spark, sf_dir):
    return _told(spark, sf_dir).where("reason is null").select("doc_id", F.col("block_no").cast("long").alias("block_no"), "label", (F.col("y0") * 1000).cast("long").alias("y_milli"))


@query(f"WITH {SPANS} SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM told GROUP BY 1")
def skip_reasons(spark, sf_dir):
    return _told(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {SPANS}, {KEPT} SELECT doc_id, id::BIGINT AS id, block_no::BIGINT AS block_no, page_no::BIGINT AS page_no, label FROM kept")
def reading_order(spark, sf_dir):
    return layout.paragraphs(_spans(spark, sf_dir)).select("doc_id", "id", F.col("block_no").cast("long").alias("block_no"), F.col("page_no").cast("long").alias("page_no"), "label")


@query(f"""WITH {SPANS}, regions AS (SELECT doc_id, page_no, block_no AS region_id, x0 - 10 AS x0, y0 - 5 AS y0, x0 + 120 AS x1, y0 + 70 AS y1 FROM spans WHERE block_no % 6 = 0)
SELECT r.doc_id, r.page_no::BIGINT AS page_no, region_id::BIGINT AS region_id, least(r.x0, min(g.x0)) AS x0, least(r.y0, min(g.y0)) AS y0, greatest(r.x1, max(g.x1)) AS x1, greatest(r.y1, max(g.y1)) AS y1
FROM regions r LEFT JOIN spans g ON r.doc_id = g.doc_id AND r.page_no = g.page_no AND (g.x0 + g.x1) / 2 BETWEEN r.x0 AND r.x1 AND (g.y0 + g.y1) / 2 BETWEEN r.y0 AND r.y1
GROUP BY r.doc_id, r.page_no, region_id, r.x0, r.y0, r.x1, r.y1""")
def region_union(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    regions = spans.where("block_no % 6 = 0").select("doc_id", "page_no", F.col("block_no").alias("region_id"), (F.col("x0") - 10).alias("x0"), (F.col("y0") - 5).alias("y0"), (F.col("x0") + 120).alias("x1"), (F.col("y0") + 70).alias("y1"))
    found = layout.region_union(regions, spans, ["doc_id", "page_no"])
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_no", "region_id")})


def _sections(spark, sf_dir):
    """The benchmark's texts in blocks of a hundred items as reference sections."""
    items = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 100).alias("section"), "item_id", text.squash(F.col("text")).alias("s"))
    return items.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "s"))), lambda r: r["s"]), "").alias("text"))


HITS = f"""sections AS (SELECT item_id // 100 AS section, string_agg(s, '' ORDER BY item_id) AS body FROM (SELECT item_id, {SQUASHED} AS s FROM benchmark) GROUP BY 1),
pieces AS (SELECT doc_id, line_no, line, regexp_replace(lower(regexp_replace(line, '\\{{v[0-9]+\\}}|<[^>]+>', ' ', 'g')), '[^a-z0-9]', '', 'g') AS s FROM lines),
keyed AS (SELECT *, CASE WHEN length(s) < 12 THEN NULL WHEN length(s) > 60 THEN substr(s, length(s) // 4 + 1, 40) ELSE s END AS k FROM pieces)"""


def _keyed(spark, sf_dir):
    lines = lines_of(spark, sf_dir).withColumn("s", text.squash(F.col("line")))
    return lines.withColumn("k", references.search_key(F.col("s")))


@query(f"WITH {LINES}, {HITS} SELECT doc_id, line_no::BIGINT AS line_no, section::BIGINT AS section FROM keyed JOIN sections ON contains(body, k)")
def reference_hits(spark, sf_dir):
    found = references.containing(_keyed(spark, sf_dir), _sections(spark, sf_dir), "section", keep=("doc_id", "line_no"))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "section")


@query(f"""WITH {LINES}, {HITS} SELECT doc_id, line_no::BIGINT AS id, CASE WHEN EXISTS (SELECT 1 FROM sections WHERE contains(body, k)) THEN line ELSE 'sent: ' || line END AS output FROM keyed""")
def reference_split(spark, sf_dir):
    rows, own = _keyed(spark, sf_dir), ["doc_id", "line_no"]
    cited = references.containing(rows, _sections(spark, sf_dir), "section", keep=tuple(own)).select(own).distinct().withColumn("cited", F.lit(True))
    flagged = rows.join(cited, own, "left").select("doc_id", F.col("line_no").cast("long").alias("id"), F.col("line").alias("input"), F.coalesce("cited", F.lit(False)).alias("cited"))
    return references.split_and_merge(flagged, "cited", lambda r: r.withColumn("output", F.concat(F.lit("sent: "), "input"))).select("doc_id", "id", "output")


def _pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    after = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", "role", F.col("text").alias("source"), F.lead("text").over(after).alias("revised")).where("role = 'user' and revised is not null")


PAIRS = """pairs AS (SELECT * FROM (SELECT conv_id, turn, role, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS revised FROM conversations) WHERE role = 'user' AND revised IS NOT NULL)"""
NUMBERS = r"\d+(?:[.,]\d+)?"


def _half_sql(odd: int) -> str:
    return f"SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(array_to_string([x FOR x, i IN string_split(text, chr(10)) IF i % 2 = {1 - odd}], chr(10)), '{NUMBERS}')) AS t FROM documents) GROUP BY ALL"


@query(f"""WITH a AS ({_half_sql(0)}), b AS ({_half_sql(1)})
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.t, b.t) AS token, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)::BIGINT AS missing, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)::BIGINT AS extra
FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.t = b.t WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def token_multiset_diff(spark, sf_dir):
    """The numbers of each document's odd and even lines."""
    lines = F.split("text", "\n")
    half = lambda odd: tokens.multiset(F.array_join(F.filter(lines, lambda x, i: i % 2 == odd), "\n"))
    both = table(spark, sf_dir, "documents").select("doc_id", half(0).alias("a"), half(1).alias("b"))
    both = both.withColumn("missing", tokens.minus(F.col("a"), F.col("b"))).withColumn("extra", tokens.minus(F.col("b"), F.col("a")))
    names = both.select("doc_id", "missing", "extra", F.explode(F.array_union(F.map_keys("missing"), F.map_keys("extra"))).alias("token"))
    return names.select("doc_id", "token", F.coalesce(F.col("missing")[F.col("token")], F.lit(0)).cast("long").alias("missing"), F.coalesce(F.col("extra")[F.col("token")], F.lit(0)).cast("long").alias("extra"))


WORD_ROWS = "VALUES (1, 'One study and the first of two'), (2, 'none of the ones'), (3, 'Ten, tenth; second'), (4, NULL)"


@query("SELECT id, digit, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT id, '{d}' AS digit, len(regexp_extract_all(txt, '(?i)\\b{w}\\b')) AS n FROM ({WORD_ROWS}) v(id, txt)" for d, words in tokens.NUMBER_WORDS.items() for w in words) + ") GROUP BY id, digit HAVING sum(n) > 0")
def number_word_allowance(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM ({WORD_ROWS}) v(id, txt)")
    return rows.select("id", F.explode(tokens.number_words(F.col("txt"))).alias("digit", "n")).withColumn("n", F.col("n").cast("long"))


GUARDED = terms.terms_of(["heat"], {"heat": ("warmth",)})


@query(rf"""WITH {PAIRS}, counted AS (SELECT *, list_sort(regexp_extract_all(source, '{NUMBERS}')) = list_sort(regexp_extract_all(revised, '{NUMBERS}')) AS same,
  len(regexp_extract_all(regexp_replace(source, '<[^>]+>', '', 'g'), '(?i)\bheat\b')) AS a, len(regexp_extract_all(regexp_replace(revised, '<[^>]+>', '', 'g'), '(?i)\bheat\b')) AS b,
  len(regexp_extract_all(regexp_replace(source, '<[^>]+>', '', 'g'), '\p{{L}}')) >= 40 AS prose, regexp_replace(lower(source), '[^\p{{L}}\p{{N}}]', '', 'g') = regexp_replace(lower(revised), '[^\p{{L}}\p{{N}}]', '', 'g') AS equal FROM pairs)
SELECT conv_id, turn, CASE WHEN NOT same THEN 'failed: numbers, tags or placeholders differ' WHEN a <> b THEN 'failed: term heat: expected ' || a || ', found ' || b
  WHEN a > 0 AND contains(revised, 'warmth') THEN 'failed: rejected rendering of heat' WHEN prose AND equal THEN 'failed: left untranslated' ELSE 'passed' END AS status FROM counted""")
def guard_pairs(spark, sf_dir):
    checked = _pairs(spark, sf_dir).withColumn("g", guards.guard(F.col("source"), F.col("revised"), F.lit("de"), F.lit("fr"), GUARDED))
    return checked.select("conv_id", "turn", guards.status(F.col("g")).alias("status"))


@query(ORACLE_SQL["guard_pairs"].replace("SELECT conv_id, turn, CASE", "SELECT split_part(status, ':', 1) AS status, count(*)::BIGINT AS n FROM (SELECT CASE").replace("AS status FROM counted", "AS status FROM counted) GROUP BY 1"))
def check_histogram(spark, sf_dir):
    return jobs.check_histogram(guard_pairs(spark, sf_dir), "status")


REPLIES = [
    (1, [1, 2], '```json\n[{"id": 2, "output": "b"}, {"id": 1, "output": "a"}]\n```'),
    (2, [1], 'Here it is: [{"id": 1, "output": "x", "more": 3}] and more'),
    (3, [1], '[{"id": 1, "output": 5}]'),
    (4, [1], '[{"id": true, "output": "x"}]'),
    (5, [1, 2], '[{"id": 1, "output": "x"}, {"id": 1, "output": "y"}]'),
    (6, [1], "no array"),
    (7, [0], '[{"id": 0.0, "output": "x"}]'),
    (8, [1], '{"id": 1}'),
]


@query("SELECT * FROM (VALUES (1, 'a|b', NULL), (2, 'x', NULL), (3, NULL, 'a row without id or output'), (4, NULL, 'a row without id or output'), (5, NULL, 'other ids'), (6, NULL, 'no array'), (7, NULL, 'a row without id or output'), (8, NULL, 'no array')) v(reply_id, outputs, error)")
def reply_parse(spark, sf_dir):
    rows = spark.createDataFrame(REPLIES, "reply_id int, ids array<int>, reply string").withColumn("p", replies.parsed(F.col("reply"), F.col("ids")))
    return rows.select("reply_id", F.array_join(F.transform("p.rows", lambda r: r["output"]), "|").alias("outputs"), F.col("p.error").alias("error"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' WHEN a.n > 1 OR b.n > 1 THEN 'repeated' ELSE 'ok' END AS status FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) b ON a.doc_id = b.doc_id")
def id_match(spark, sf_dir):
    return replies.id_match(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


def _escaped(c: str) -> str:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{plain}', '{safe}')"
    return c


@query(f"""WITH {SPANS}, {KEPT}, made AS (SELECT *, CASE label WHEN 'figure_text' THEN '<tr><td>' || {_escaped('text')} || '</td></tr>' WHEN 'title' THEN '<h2>' || {_escaped('text')} || '</h2>' WHEN 'caption' THEN '<figcaption>' || {_escaped('text')} || '</figcaption>' ELSE '<p>' || {_escaped('text')} || '</p>' END AS html FROM kept)
SELECT doc_id, page_no::BIGINT AS page_no, sha256('<section id="page-' || page_no || '">' || coalesce(string_agg(html, '' ORDER BY id) FILTER (label <> 'figure_text'), '')
  || CASE WHEN count(*) FILTER (label = 'figure_text') > 0 THEN '<details><summary>' || count(*) FILTER (label = 'figure_text') || '</summary><table>' || string_agg(html, '' ORDER BY id) FILTER (label = 'figure_text') || '</table></details>' ELSE '' END || '</section>') AS digest
FROM made GROUP BY doc_id, page_no""")
def html_page(spark, sf_dir):
    rows = layout.paragraphs(_spans(spark, sf_dir)).withColumn("output", F.col("text")).withColumn("checks", F.lit("passed"))
    return render.page_sections(rows, ["doc_id"]).select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.sha2("html", 256).alias("digest"))


@query("""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, sha256(string_agg(role || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS digest, count(*)::BIGINT AS n FROM ranked WHERE back <= 3 GROUP BY conv_id""")
def qa_context(spark, sf_dir):
    last = qa.recent(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("\n", "role", "text").alias("t")))), lambda s: s["t"])
    return last.groupBy("conv_id").agg(F.sha2(F.array_join(parts, "\n\n"), 256).alias("digest"), F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (1, '1,3,4,5'), (2, '1,2,3'), (3, '2,7'), (4, '3')) v(id, pages)")
def page_spec(spark, sf_dir):
    rows = spark.createDataFrame([(1, "1,3-5", 10), (2, None, 3), (3, " 7, 2,7 ", 7), (4, "3-3", 3)], "id int, spec string, n int")
    return rows.select("id", F.array_join(F.transform(library.page_numbers(F.col("spec"), F.col("n")), lambda x: x.cast("string")), ",").alias("pages"))


@query("""WITH files AS (SELECT o_custkey, count(*)::BIGINT AS n, sha256(string_agg('order-' || o_orderkey, chr(10) ORDER BY 'order-' || o_orderkey)) AS digest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey::VARCHAR AS asked, coalesce(n, 0)::BIGINT AS n, digest FROM orders LEFT JOIN files USING (o_custkey)""")
def attachments(spark, sf_dir):
    """An analogue: customers are parent items, their orders the children, finished ones the PDFs; every order is asked for."""
    orders = table(spark, sf_dir, "orders")
    items = orders.select(F.col("o_orderkey").cast("string").alias("key"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("parent"), F.when(F.col("o_orderstatus") == "F", "application/pdf").alias("content_type"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("filename"))
    return library.attachment_sets(items, items.select("key"))


@query("SELECT * FROM (VALUES ('A', '2001', 'One', 'Hall, Ito, Lin'), ('B', NULL, 'Two', 'Group'), ('C', '1999', NULL, '')) v(key, date, title, creators)")
def search_projection(spark, sf_dir):
    rows = [("A", "2001", "One", [("Hall", None), ("", "Ito"), ("Lin", "x"), ("Fourth", None)]), ("B", None, "Two", [(None, "Group")]), ("C", "1999", None, [])]
    return library.search_rows(spark.createDataFrame(rows, "key string, date string, title string, creators array<struct<lastName:string,name:string>>"))


@query("SELECT doc_id, sha256(text) AS digest, strlen(text)::BIGINT AS n_bytes FROM documents")
def doc_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


GLOSSARY_LINES = ["# a list", "heat flow | warm flow, hot flow,", "GPS  # an acronym", "", "heat flow", "isotope | 同位、 元素", "GPS | gps # later"]


@query("SELECT * FROM (VALUES (0, 'heat flow', '{v1000000}', 'warm flow|hot flow', false), (1, 'GPS', '{v1000001}', 'gps', true), (2, 'isotope', '{v1000002}', '同位|元素', false)) v(ord, term, token, banned, is_acronym)")
def glossary_parse(spark, sf_dir):
    lines = spark.createDataFrame(list(enumerate(GLOSSARY_LINES)), "line_no int, line string")
    return terms.parse_glossary(lines).withColumn("banned", F.array_join("banned", "|"))


@query()
def symbol_repairs(spark, sf_dir):
    """Lookaround has no SQL here: tests compare it with plain Python."""
    fixed = table(spark, sf_dir, "documents").select("doc_id", text.repair_symbols(F.col("text")).alias("r"))
    return fixed.select("doc_id", F.col("r.n").alias("n"), F.sha2("r.text", 256).alias("digest"))


@query("SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS n_errors, count(DISTINCT conv_id)::BIGINT AS n_batches FROM conversations")
def model_stage(spark, sf_dir):
    """Each conversation as a batch through a client that needs no model."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("text").alias("input"))
    done = model.translate(rows, lambda: model.reverse_words, "", ["conv_id"])
    return done.agg(F.count("*").alias("n_rows"), F.count("error").alias("n_errors"), F.count_distinct("conv_id").alias("n_batches"))


ECHO_TERMS = terms.terms_of(["heat"])


@query(r"""SELECT conv_id, turn AS id, sha256(lower(text)) AS output, CASE WHEN len(regexp_extract_all(regexp_replace(text, '<[^>]+>', '', 'g'), '\p{L}')) >= 40 THEN 'failed: left untranslated' ELSE 'passed' END AS checks FROM conversations""")
def translation_stage(spark, sf_dir):
    """Drafts and reviews by a client that changes nothing, so that what should have been translated fails its guard."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("text").alias("source"))
    done = translate.translated(rows, lambda: model.echo, ["conv_id"], ECHO_TERMS, "de", "fr")
    return done.select("conv_id", "id", F.sha2(F.lower("output"), 256).alias("output"), "checks")


@query("SELECT * FROM (VALUES (1, '漢語與書', '汉语与书'), (2, 'abc', 'abc'), (3, NULL, NULL)) v(id, traditional, simplified)")
def script_conversion(spark, sf_dir):
    rows = spark.createDataFrame([(1, "汉语与书"), (2, "abc"), (3, None)], "id int, t string")
    to = rows.select("id", script.convert_script(F.col("t"), "zh-TW").alias("traditional"))
    return to.withColumn("simplified", script.convert_script(F.col("traditional"), "zh-CN"))


@query(r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+-[a-z]+'))).list_aggregate('string_agg', ' ') AS compounds FROM documents WHERE regexp_matches(lower(text), '[a-z]+-[a-z]+')""")
def compound_words(spark, sf_dir):
    found = layout.compounds(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return found.select("doc_id", F.array_join("compounds", " ").alias("compounds"))


@query(f"WITH {SPANS} SELECT doc_id, block_no::BIGINT AS block_no, round(x0 / width * 10000)::BIGINT AS l, round(y0 / height * 10000)::BIGINT AS t, round((x1 - x0) / width * 10000)::BIGINT AS w, round((y1 - y0) / height * 10000)::BIGINT AS h FROM spans")
def percent_boxes(spark, sf_dir):
    rows = _spans(spark, sf_dir).select("doc_id", F.col("block_no").cast("long").alias("block_no"), *layout.percent_box())
    return rows.select("doc_id", "block_no", *[F.round(F.col(c) * 100).cast("long").alias(c[0]) for c in ("left", "top", "width", "height")])


@query(rf"""WITH {SPANS}, pages AS (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY block_no) AS t FROM spans GROUP BY 1, 2)
SELECT doc_id, count(*)::BIGINT AS n_pages, coalesce(string_agg(page_no::VARCHAR, ',' ORDER BY page_no) FILTER (length(regexp_replace(t, '^\s+|\s+$', '', 'g')) < 30), '') AS low_text FROM pages GROUP BY 1""")
def low_text_pages(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda s: s["text"])
    pages = _spans(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.array_join(ordered, "\n").alias("text"))
    return pdf.low_text_pages(pages, ["doc_id"]).select("doc_id", "n_pages", F.array_join(F.transform("low_text", lambda p: p.cast("string")), ",").alias("low_text"))


@query("SELECT * FROM (VALUES ('a', NULL), ('b', 'not a PDF'), ('c', 'encrypted'), ('d', 'empty file')) v(path, problem)")
def pdf_preflight(spark, sf_dir):
    rows = [("a", b"%PDF-1.7 ..."), ("b", b"<html>"), ("c", b"%PDF-1.4 /Encrypt 5 0 R"), ("d", b"")]
    return pdf.preflight(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).select("path", "problem")


@query("SELECT source, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY source")
def ordered_digest(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("d"), F.octet_length("text").alias("n"))
    return audit.ordered_digest(files, ["source"], "doc_id", "d", "n")


@query(f"""WITH told AS ({ORACLE_SQL["translation_stage"]}) SELECT 'failed batches' AS gate, count(DISTINCT conv_id) FILTER (checks <> 'passed')::BIGINT AS n FROM told
UNION ALL SELECT 'any output', bool_or(output IS NOT NULL)::BIGINT FROM told UNION ALL SELECT 'any error', bool_or(checks <> 'passed')::BIGINT FROM told""")
def job_gates(spark, sf_dir):
    done = translation_stage(spark, sf_dir)
    gates = audit.gates(done).select(F.explode(F.array(F.struct(F.lit("any output").alias("gate"), F.col("any_output").cast("long").alias("n")), F.struct(F.lit("any error").alias("gate"), F.col("any_error").cast("long").alias("n")))).alias("g")).select("g.*")
    return audit.failed_batches(done, "conv_id").select(F.lit("failed batches").alias("gate"), F.col("n_failed").alias("n")).unionByName(gates)


@query(f"""WITH {LINES}, {HITS} SELECT count(*)::BIGINT AS n_lines, count(DISTINCT s)::BIGINT AS n_texts FROM keyed WHERE EXISTS (SELECT 1 FROM sections WHERE contains(body, k))""")
def skipped_references(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    cited = references.containing(rows, _sections(spark, sf_dir), "section", keep=("doc_id", "line_no", "s")).select("doc_id", "line_no", "s").distinct()
    return cited.agg(F.count("*").alias("n_lines"), F.count_distinct("s").alias("n_texts"))


@query("SELECT * FROM (VALUES (1, ''), (2, 'model,size'), (3, 'size')) v(id, changed)")
def config_drift(spark, sf_dir):
    rows = [(1, {"model": "a", "size": "1"}, {"model": "a", "size": "1"}), (2, {"model": "a"}, {"model": "b", "size": "2"}), (3, {"size": None}, {"size": "1"})]
    found = spark.createDataFrame(rows, "id int, old map<string,string>, new map<string,string>")
    return found.select("id", F.array_join(audit.drift(F.col("old"), F.col("new")), ",").alias("changed"))


MARKED = [(1, 'Do this. INPUT: [{"id": 1, "input": "a"}, {"id": 2, "input": "b"}] '), (2, "INPUT: [{"), (3, "nothing"), (4, 'INPUT: [{"id": 1, "input": 5}]')]


@query("SELECT * FROM (VALUES (1, '1=a|2=b', '[{\"id\":1,\"output\":\"A\"},{\"id\":3,\"output\":\"kept\"}]', 'other keys'), (2, NULL, 'sorry', 'no array'), (3, NULL, 'sorry', 'no array'), (4, NULL, 'sorry', 'no array')) v(id, inputs, merged, problem)")
def embedded_batches(spark, sf_dir):
    kept = F.array(F.struct(F.lit(3).cast("long").alias("id"), F.lit("kept").alias("output")))
    rows = spark.createDataFrame(MARKED, "id int, prompt string").withColumn("reply", F.when(F.col("id") == 1, '[{"id": 1, "output": "A"}]').otherwise("sorry"))
    found = F.transform(replies.embedded(F.col("prompt"), "INPUT:"), lambda r: F.concat_ws("=", r["id"].cast("string"), r["input"]))
    problem = replies.strict_error(F.replace("reply", F.lit('"A"'), F.lit('"A", "more": 1')), F.array(F.lit(1)))
    return rows.select("id", F.array_join(found, "|").alias("inputs"), replies.merged(F.col("reply"), kept).alias("merged"), problem.alias("problem"))


HEADINGS = ["References", "3. RÉFÉRENCES", "参 考 文 献", "Bibliography and more", "Literaturverzeichnis", "References  cited"]


def _headed(spark, sf_dir):
    """Spans of which the fifteenth line of every second document, and the third of some, is made a heading or something like one."""
    spans = _spans(spark, sf_dir)
    made = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("doc_id") % len(HEADINGS) + 1).cast("int"))
    late, early = (F.col("block_no") == 14) & (F.col("doc_id") % 2 == 0), (F.col("block_no") == 2) & (F.col("doc_id") % 5 == 0)
    return spans.withColumn("text", F.when(late, made).when(early, "references").otherwise(F.col("text")))


HEADED = f"""{SPANS.split("body AS (")[0]}headed AS (
  SELECT * REPLACE (CASE WHEN block_no = 14 AND doc_id % 2 = 0 THEN {HEADINGS!r}[doc_id % 6 + 1] WHEN block_no = 2 AND doc_id % 5 = 0 THEN 'references' ELSE text END AS text) FROM spans),
headings AS (
  SELECT doc_id, arg_max({{'page': page_no, 'place': (x0 > width / 2)::INT * 10000 + y0}}, block_no) AS h FROM headed
  WHERE regexp_matches(trim(text), '(?i)^((\\d+\\.?\\s*)?(references?( cited)?|bibliography|literaturverzeichnis|références|参考文献))$') OR regexp_matches(regexp_replace(text, '\\s+', ' ', 'g'), '(?i)^references cited$') OR text = '参 考 文 献' GROUP BY doc_id),
found AS (SELECT s.*, h, CASE WHEN page_no > h.page OR page_no = h.page AND (x0 > width / 2)::INT * 10000 + y0 > h.place + 1 THEN 'references' WHEN x1 - x0 < 20 THEN 'narrow margin text' WHEN NOT regexp_matches(text, '\\p{{L}}{{3}}') THEN 'no words'
  WHEN y1 < height * 0.085 THEN 'running header' ELSE 'kept' END AS reason FROM headed s LEFT JOIN headings USING (doc_id) WHERE trim(text) <> '')"""


@query(f"WITH {HEADED} SELECT doc_id, reason, count(*)::BIGINT AS n, coalesce(any_value(h.page), 0)::BIGINT AS heading_page FROM found GROUP BY doc_id, reason")
def reference_skips(spark, sf_dir):
    """What is skipped once the last heading of the references is known."""
    spans = _headed(spark, sf_dir)
    rows = layout.told(spans, layout.references_heading(spans))
    return rows.groupBy("doc_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.coalesce(F.first("heading.page_no"), F.lit(0)).cast("long").alias("heading_page"))


@query(f"WITH {SPANS}, {KEPT} SELECT page_no::BIGINT AS page_no, label, CASE WHEN label = 'figure_text' AND length(text) > 80 THEN 'not translated' END AS checks, count(*)::BIGINT AS n FROM kept GROUP BY ALL")
def figure_policy(spark, sf_dir):
    rows = layout.paragraphs(_spans(spark, sf_dir))
    return rows.groupBy(F.col("page_no").cast("long").alias("page_no"), "label", "checks").agg(F.count("*").alias("n"))


def _torn(spark, sf_dir):
    """Texts cut into lines of forty characters, with a hyphen where a word is torn; blocks of six lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("t")).where("t <> ''")
    torn = lambda own: F.transform(own, lambda x, k: F.concat(x, F.when(x.rlike(r"[a-z]\z") & F.coalesce(F.get(own, k + 1).rlike(r"\A[a-z]"), F.lit(False)), "-").otherwise("")))
    lines = text.bound(F.regexp_extract_all("t", F.lit("(.{1,40})"), F.lit(1)), torn)
    rows = docs.select("doc_id", F.posexplode(lines).alias("n", "text")).withColumns({"block_no": F.floor(F.col("n") / 6).cast("int"), "line_no": F.col("n") % 6})
    place = F.col("line_no") * 15.0
    size = F.when(F.col("n") % 5 == 0, 12.0).when(F.col("block_no") % 4 == 3, 6.0).otherwise(10.0)
    return rows.select("doc_id", F.lit(1).alias("page_no"), "block_no", "line_no", F.lit(72.0).alias("x0"), (100 + place).alias("y0"), F.lit(300.0).alias("x1"), (115 + place).alias("y1"), size.alias("size"), "text")


@query(r"""WITH plain AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents), known AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+-[a-z]+')) AS w FROM documents),
numbered AS (SELECT doc_id, t, unnest(range(0, (length(t) - 1) // 40 + 1)) AS n FROM plain WHERE t <> ''),
lines AS (SELECT doc_id, n, substr(t, n * 40 + 1, 40) || CASE WHEN regexp_matches(substr(t, n * 40 + 1, 40), '[a-z]$') AND regexp_matches(substr(t, n * 40 + 41, 40), '^[a-z]') THEN '-' ELSE '' END AS l, CASE WHEN n % 5 = 0 THEN 12.0 WHEN n // 6 % 4 = 3 THEN 6.0 ELSE 10.0 END AS size FROM numbered),
body AS (SELECT doc_id, size AS body FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY sum(length(trim(l))) DESC, min(n)) AS r FROM lines GROUP BY doc_id, size) WHERE r = 1),
own AS (SELECT doc_id, b, size FROM (SELECT doc_id, n // 6 AS b, size, row_number() OVER (PARTITION BY doc_id, n // 6 ORDER BY sum(length(trim(l))) DESC, min(n)) AS r FROM lines GROUP BY doc_id, b, size) WHERE r = 1),
held AS (SELECT doc_id, n // 6 AS b, list(trim(l) ORDER BY n) FILTER (trim(l) <> '') AS ls FROM lines GROUP BY doc_id, b),
made AS (SELECT doc_id, b, len(ls) AS k, list_reduce(ls, lambda a, x: CASE WHEN NOT regexp_matches(a, '[A-Za-z]-$') OR NOT regexp_matches(x, '^[a-z]') THEN a || ' ' || x WHEN list_contains(w, lower(regexp_extract(a, '([A-Za-z]+-)$', 1) || regexp_extract(x, '^([a-z]+)', 1))) THEN a || x ELSE a[:-2] || x END) AS text FROM held JOIN known USING (doc_id) WHERE len(ls) > 0)
SELECT doc_id, b::BIGINT AS block_no, size, CASE WHEN size < 0.75 * body THEN 'figure_text' WHEN k <= 2 AND length(text) < 120 AND NOT regexp_matches(text, '[.,;:]$') AND size >= 0.95 * body THEN 'title' ELSE 'text' END AS label, sha256(text) AS digest
FROM made JOIN own USING (doc_id, b) JOIN body USING (doc_id) WHERE regexp_matches(text, '\p{L}{3}')""")
def block_paragraphs(spark, sf_dir):
    """Lines to blocks: joined without hyphens, with each block's own size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = layout.told(layout.blocks(_torn(spark, sf_dir), layout.compounds(docs, "doc_id"))).where("reason is null")
    return rows.select("doc_id", F.col("block_no").cast("long").alias("block_no"), "size", "label", F.sha2("text", 256).alias("digest"))


TORN_TERMS = terms.terms_of(["tion", "Heat tion", "AND"])


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '(?i)\bH(?:[ \t]*|-\s+)e(?:[ \t]*|-\s+)a(?:[ \t]*|-\s+)t\s+t(?:[ \t]*|-\s+)i(?:[ \t]*|-\s+)o(?:[ \t]*|-\s+)n\b', 'Heat tion', 'g'), '(?i)\bt(?:[ \t]*|-\s+)i(?:[ \t]*|-\s+)o(?:[ \t]*|-\s+)n\b', 'tion', 'g')) AS digest
FROM (SELECT doc_id, replace(replace(text, 'ion ', 'I- on '), ' of ', ' he At ti on ') AS t FROM documents)""")
def rejoined_terms(spark, sf_dir):
    torn = F.replace(F.replace("text", F.lit("ion "), F.lit("I- on ")), F.lit(" of "), F.lit(" he At ti on "))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(terms.normalize(torn, TORN_TERMS), 256).alias("digest"))


@query(r"""WITH every AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 3 THEN 'Two of the first. ' || text ELSE text END AS source,
  CASE conv_id % 4 WHEN 0 THEN '這是 ' || text WHEN 1 THEN text WHEN 2 THEN '這是 7 ' || text ELSE '這 2 1 ' || text END AS revised FROM conversations),
a AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(source, '\d+(?:[.,]\d+)?')) AS t FROM every) GROUP BY ALL),
b AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(revised, '\d+(?:[.,]\d+)?')) AS t FROM every) GROUP BY ALL),
words AS (SELECT conv_id, turn, lower(unnest(regexp_extract_all(source, '(?i)\b(?:one|first|two|second|three|third|four|fourth|five|fifth|six|sixth|seven|seventh|eight|eighth|nine|ninth|ten|tenth)\b'))) AS w FROM every),
allowed AS (SELECT conv_id, turn, CASE WHEN w IN ('one', 'first') THEN '1' WHEN w IN ('two', 'second') THEN '2' WHEN w IN ('three', 'third') THEN '3' WHEN w IN ('four', 'fourth') THEN '4' WHEN w IN ('five', 'fifth') THEN '5' WHEN w IN ('six', 'sixth') THEN '6' WHEN w IN ('seven', 'seventh') THEN '7' WHEN w IN ('eight', 'eighth') THEN '8' WHEN w IN ('nine', 'ninth') THEN '9' ELSE '10' END AS t, count(*) AS n FROM words GROUP BY ALL),
bad AS (SELECT DISTINCT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.t = b.t LEFT JOIN allowed c ON c.conv_id = b.conv_id AND c.turn = b.turn AND c.t = b.t
  WHERE coalesce(a.n, 0) > coalesce(b.n, 0) OR coalesce(b.n, 0) - coalesce(a.n, 0) > coalesce(c.n, 0))
SELECT conv_id, turn, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE bad.conv_id = every.conv_id AND bad.turn = every.turn) THEN 'failed: numbers, tags or placeholders differ'
  WHEN regexp_matches(source, '(?i)\b(is|are|was|were|have|has|we|this|these|those|reflects|show|shows|shown|can)\b') AND NOT regexp_matches(revised, '[\x{4e00}-\x{9fff}]') THEN 'failed: prose became English' ELSE 'passed' END AS status FROM every""")
def guard_default_pair(spark, sf_dir):
    """English to Traditional Chinese, with revisions that are faithful, that stay English, that have one number more and that
    write number words as digits."""
    own, kind = F.col("text"), F.col("conv_id") % 4
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(kind == 3, F.concat(F.lit("Two of the first. "), own)).otherwise(own).alias("s"), F.when(kind == 0, F.concat(F.lit("這是 "), own)).when(kind == 1, own).when(kind == 2, F.concat(F.lit("這是 7 "), own)).otherwise(F.concat(F.lit("這 2 1 "), own)).alias("r"))
    checked = rows.withColumn("g", guards.guard(F.col("s"), F.col("r"), F.lit("en"), F.lit("zh-TW"), []))
    return checked.select("conv_id", "turn", guards.status(F.col("g")).alias("status"))


@query(f"""WITH {SPANS}, {KEPT}, numbers AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS at FROM (SELECT DISTINCT doc_id, page_no FROM kept)), outs AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS at FROM (SELECT DISTINCT doc_id, page_no FROM spans WHERE page_no % 2 = 1))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page_no, 0)::BIGINT AS source, coalesce(b.page_no, 0)::BIGINT AS output FROM numbers a FULL JOIN outs b ON a.doc_id = b.doc_id AND a.at = b.at""")
def paired_pages(spark, sf_dir):
    """Pages with kept text, and every second page, by position."""
    spans = _spans(spark, sf_dir)
    own = layout.paragraphs(spans).select("doc_id", F.col("page_no").cast("long").alias("page_no")).distinct()
    other = spans.where("page_no % 2 = 1").select("doc_id", F.col("page_no").cast("long").alias("page_no")).distinct()
    return layout.paired_pages(own, other, ["doc_id"]).na.fill(0, ["source", "output"])


@query(f"""WITH {SPANS}, {KEPT}, made AS (SELECT *, CASE WHEN label = 'figure_text' THEN '<tr><td>' || {_escaped('left(text, 80)')} || '</td><td>' || CASE WHEN length(text) > 80 THEN '<em>see the page</em>' ELSE {_escaped('text')} END || '</td></tr>' WHEN label = 'title' THEN '<h2>' || {_escaped('text')} || '</h2>' WHEN label = 'caption' THEN '<figcaption>' || {_escaped('text')} || '</figcaption>' ELSE '<p>' || {_escaped('text')} || '</p>' END AS html FROM kept),
sections AS (SELECT doc_id, page_no, coalesce(string_agg(html, '' ORDER BY id) FILTER (label <> 'figure_text'), '') || CASE WHEN count(*) FILTER (label = 'figure_text') > 0 THEN '<details><summary>' || count(*) FILTER (label = 'figure_text') || '</summary><table>' || string_agg(html, '' ORDER BY id) FILTER (label = 'figure_text') || '</table></details>' ELSE '' END AS body FROM made GROUP BY doc_id, page_no),
whole AS (SELECT doc_id, page_no, '<section id="page-' || page_no || '">' || coalesce(body, '') || CASE WHEN page_no >= 3 THEN '<p>References</p>' WHEN body IS NULL THEN '<p>Nothing on this page</p>' ELSE '' END || '<img alt="page ' || page_no || '" loading="lazy" src="data:image/jpeg;base64,' || to_base64(encode('jpeg ' || doc_id || ' ' || page_no)) || '"></section>' AS html
  FROM (SELECT DISTINCT doc_id, page_no FROM every) LEFT JOIN sections USING (doc_id, page_no))
SELECT doc_id, sha256('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>' || any_value(source) || ' &lt;' || doc_id || '&gt;</title><style>{render.STYLE}</style></head><body><header><h1>' || any_value(source) || ' &lt;' || doc_id || '&gt;</h1></header><nav>' || string_agg('<a href="#page-' || page_no || '">' || page_no || '</a>', '' ORDER BY page_no) || '</nav><main>' || string_agg(html, '' ORDER BY page_no) || '</main><footer><dl><dt>lang</dt><dd>' || any_value(lang) || '</dd><dt>none</dt><dd></dd></dl></footer><aside><form name="ask" data-token="{{token}}" data-first="1"><textarea name="question"></textarea><label><input type="checkbox" name="full">all pages</label><button>Ask</button><output name="answer"></output></form></aside><script>{render.SCRIPT.replace("'", "''")}</script></body></html>') AS digest
FROM whole JOIN documents USING (doc_id) GROUP BY doc_id""")
def reading_pages(spark, sf_dir):
    """Whole documents as reading pages; from the third page on they are taken for references, and the images are not real ones."""
    docs = table(spark, sf_dir, "documents")
    every = layout.document_spans(docs.select("doc_id", "text"))
    rows = layout.paragraphs(every).withColumns({"source": F.col("text"), "output": F.when(F.col("checks").isNull(), F.col("text")).otherwise("")})
    jpeg = F.concat_ws(" ", F.lit("jpeg"), F.col("doc_id").cast("string"), F.col("page_no").cast("string")).cast("binary")
    pages = every.select("doc_id", "page_no").distinct().withColumns({"jpeg": jpeg, "ref": F.lit(3)})
    titles = docs.select("doc_id", F.concat("source", F.lit(" <"), F.col("doc_id").cast("string"), F.lit(">")).alias("title"), F.array(F.struct(F.lit("lang").alias("name"), F.col("lang").alias("value")), F.struct(F.lit("none").alias("name"), F.lit(None).cast("string").alias("value"))).alias("facts"))
    whole = render.reading_pages(render.page_sections(rows, ["doc_id"], references_page="ref", pages=pages), titles, ["doc_id"])
    return whole.select("doc_id", F.sha2("html", 256).alias("digest"))


@query("""SELECT c_custkey, array_to_string(CASE WHEN c_custkey % 13 = 0 THEN range(1, 21) ELSE list_sort(list_distinct([c_custkey % 7 + 1] || range(c_custkey % 11 + 1, c_custkey % 11 + c_custkey % 5 + 2))) END, ',') AS pages FROM customer""")
def page_lists(spark, sf_dir):
    """A list of pages for each customer, made of its key."""
    k, text_of = F.col("c_custkey"), lambda c: c.cast("string")
    spec = F.concat(text_of(k % 7 + 1), F.lit(", "), text_of(k % 11 + 1), F.lit("-"), text_of(k % 11 + k % 5 + 1), F.lit(" ,"), text_of(k % 7 + 1))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 13 != 0, spec).alias("spec"))
    return rows.select("c_custkey", F.array_join(F.transform(library.page_numbers(F.col("spec"), F.lit(20)), text_of), ",").alias("pages"))


WORDED = "replace(replace(replace(text, ' the ', ' One '), ' of ', ' tenth '), ' and ', ' two seconds ')"


@query("SELECT doc_id, digit, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{d}' AS digit, len(regexp_extract_all({WORDED}, '(?i)\\b{w}\\b')) AS n FROM documents" for d, words in tokens.NUMBER_WORDS.items() for w in words) + ") GROUP BY doc_id, digit HAVING sum(n) > 0")
def number_words(spark, sf_dir):
    """Documents in which some short words are made number words."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens.number_words(F.expr(WORDED))).alias("digit", "n"))
    return rows.withColumn("n", F.col("n").cast("long"))


@query("""SELECT n_name AS key, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey::VARCHAR END AS date, n_name AS title, array_to_string(coalesce(list(coalesce(CASE WHEN s_suppkey % 3 = 2 THEN s_name END, CASE WHEN s_suppkey % 5 > 0 THEN 'n' || s_suppkey END, '') ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL), [])[1:3], ', ') AS creators
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey, n_regionkey""")
def item_projection(spark, sf_dir):
    """Nations as library items, their suppliers as creators with one kind of name or the other."""
    k = F.col("s_suppkey")
    person = F.struct(k.alias("k"), F.when(k % 3 == 2, F.col("s_name")).when(k % 3 == 1, "").alias("lastName"), F.when(k % 5 > 0, F.concat(F.lit("n"), k.cast("string"))).alias("name"))
    people = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(person)).alias("p"))
    creators = F.transform(F.coalesce("p", F.array().cast("array<struct<k:bigint,lastName:string,name:string>>")), lambda x: F.struct(x["lastName"].alias("lastName"), x["name"].alias("name")))
    items = table(spark, sf_dir, "nation").join(people, "n_nationkey", "left").select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey").cast("string")).alias("date"), F.col("n_name").alias("title"), creators.alias("creators"))
    return library.search_rows(items)


@query("""WITH lines AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 3 = 0 THEN replace(p_brand, '#', '-') || '|' || p_size END AS banned FROM part WHERE p_partkey % 3 < 2),
known AS (SELECT p_type AS term, min(p_partkey) AS first, coalesce(arg_max(banned, p_partkey) FILTER (banned IS NOT NULL), '') AS banned FROM lines GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS ord FROM known)
SELECT ord::BIGINT AS ord, term, '{v' || (1000000 + ord) || '}' AS token, banned, term = upper(term) AND term <> lower(term) AS is_acronym FROM numbered""")
def glossary_lines(spark, sf_dir):
    """A glossary with a line for each part: a type with banned renderings, a type with a comment, or nothing but a comment."""
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat("p_type", F.lit(" | "), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("，"), F.col("p_size").cast("string"), F.lit(", # no more"))).when(k % 3 == 1, F.concat(F.lit("  "), "p_type", F.lit(" # | none"))).otherwise(F.lit("# | nothing"))
    lines = table(spark, sf_dir, "part").select(k.alias("line_no"), line.alias("line"))
    return terms.parse_glossary(lines).select(F.col("ord").cast("long").alias("ord"), "term", "token", F.array_join("banned", "|").alias("banned"), "is_acronym")


@query("""SELECT doc_id, sha256(CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '%PDF-1.7 ' || text WHEN 2 THEN text WHEN 3 THEN '%PDF-1.4 /Encrypt 5 0 R ' || text ELSE '%PDF-1.4 /Encryption ' || text END) AS sha256,
CASE doc_id % 5 WHEN 0 THEN 'empty file' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'no pages' END WHEN 2 THEN 'not a PDF' WHEN 3 THEN 'encrypted' ELSE CASE WHEN doc_id % 2 = 0 THEN 'no pages' END END AS problem FROM documents""")
def file_preflight(spark, sf_dir):
    """Documents as the contents of files, good and bad."""
    kind, own = F.col("doc_id") % 5, F.col("text")
    content = F.when(kind == 0, F.lit("")).when(kind == 1, F.concat(F.lit("%PDF-1.7 "), own)).when(kind == 2, own).when(kind == 3, F.concat(F.lit("%PDF-1.4 /Encrypt 5 0 R "), own)).otherwise(F.concat(F.lit("%PDF-1.4 /Encryption "), own))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), content.cast("binary").alias("content"), (F.col("doc_id") % 2).alias("page_count"))
    return pdf.preflight(files).withColumnRenamed("path", "doc_id")


@query("""SELECT o_orderkey, array_to_string([x FOR x IN [CASE WHEN o_orderkey % 3 = 0 THEN 'model' END, CASE WHEN o_orderkey % 2 = 1 AND o_orderstatus <> 'F' THEN 'size' END] IF x IS NOT NULL], ',') AS changed FROM orders""")
def fact_drift(spark, sf_dir):
    """Facts of each order before and after: one that may change, one that may be new."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    old = F.create_map(F.lit("size"), status, F.lit("gone"), F.lit("x"))
    new = F.map_concat(F.create_map(F.lit("size"), F.when(key % 2 == 1, "F").otherwise(status)), F.when(key % 3 == 0, F.create_map(F.lit("model"), F.lit("m"))).otherwise(F.create_map().cast("map<string,string>")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(audit.drift(old, new), ",").alias("changed"))


@query("""WITH held AS (SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS t FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 6 IN (0, 1, 5) THEN sha256(t) ELSE '' END AS outputs, CASE conv_id % 6 WHEN 2 THEN 'no array' WHEN 3 THEN 'other ids' WHEN 4 THEN 'a row without id or output' ELSE '' END AS error FROM held""")
def reply_batches(spark, sf_dir):
    """Each conversation as a model's reply: fenced, with text around it, without an array, with a row too many, with numbers as
    outputs, with more keys."""
    kind = F.col("conv_id") % 6
    row = F.struct(F.col("turn").alias("id"), F.col("text").alias("output"))
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    json_of = F.to_json("r")
    wide = F.to_json(F.transform("r", lambda r: F.struct(r["id"].alias("id"), r["output"].alias("output"), F.lit(1).alias("more"))))
    numbers = F.to_json(F.transform("r", lambda r: F.struct(r["id"].alias("id"), r["id"].alias("output"))))
    twice = F.to_json(F.concat("r", F.slice("r", 1, 1)))
    reply = F.when(kind == 0, F.concat(F.lit("```json\n"), json_of, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Here: "), json_of, F.lit(" done"))).when(kind == 2, "sorry").when(kind == 3, twice).when(kind == 4, numbers).otherwise(wide)
    parsed = held.withColumn("p", replies.parsed(reply, F.transform("r", lambda r: r["id"])))
    outputs = F.sha2(F.array_join(F.transform("p.rows", lambda r: r["output"]), "|"), 256)
    return parsed.select("conv_id", F.coalesce(outputs, F.lit("")).alias("outputs"), F.coalesce("p.error", F.lit("")).alias("error"))


@query("""WITH held AS (SELECT conv_id, string_agg(turn || '=' || text, '|' ORDER BY turn) AS t FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN sha256(t) ELSE '' END AS inputs, CASE conv_id % 3 WHEN 0 THEN '' ELSE 'passed on' END AS how FROM held""")
def prompt_batches(spark, sf_dir):
    """Each conversation as a batch within a prompt: after the marker, without it, or malformed; those are passed on whole."""
    row = F.struct(F.col("turn").alias("id"), F.col("text").alias("input"))
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("r"))
    kind = F.col("conv_id") % 3
    prompt = F.when(kind == 0, F.concat(F.lit("Do this. INPUT:\n"), "r")).when(kind == 1, F.col("r")).otherwise(F.concat(F.lit("INPUT: {"), "r"))
    found = held.withColumn("b", replies.embedded(prompt, "INPUT:"))
    inputs = F.sha2(F.array_join(F.transform("b", lambda r: F.concat_ws("=", r["id"].cast("string"), r["input"])), "|"), 256)
    return found.select("conv_id", F.coalesce(inputs, F.lit("")).alias("inputs"), F.when(F.col("b").isNull(), "passed on").otherwise("").alias("how"))
