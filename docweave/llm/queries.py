"""The registered queries opN_<name>: each applies one operator of this package to its whole table and
derives the result columns of its contract. ORACLE_SQL has the same results in DuckDB SQL where that is possible."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontaminate, host_reputation, html_main, image_copies, language_id, mixing, near_dedup, secrets, sharding, warc
from docweave.llm.common import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans into one ledger: the second finds the base rules' pairs there and looks for what is new."""
    docs, ledger = _table(spark, sf_dir, "documents").select("doc_id", "text"), secrets.fresh_ledger(spark)
    secrets.scan(docs, ledger, secrets.BASE_RULES)
    found = secrets.scan(docs, ledger)
    base = [r.kind for r in secrets.BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kinds: F.filter("findings", lambda s: s["kind"].isin(kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(base)), 256).alias("base_sha256"), joined("findings").alias("spans"))


def _secrets_sql() -> str:
    """Each match is looked for from the end of the one before: its text cannot occur between the two, or the pattern would have
    matched there. Letters in either case are spelled out, for RE2 folds some that aren't ASCII."""
    either = lambda p: re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", p[: p.index(")")]) + p[p.index(")") :]  # noqa: E731  # the key words, the first group
    rules = [(k, r, (either(r.pattern) if r.any_case else r.pattern).replace("'", "''")) for k, r in enumerate(secrets.BASE_RULES + secrets.MORE_RULES)]
    kinds = [f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, text, regexp_extract_all(text, '{p}') AS m FROM texts" for k, r, p in rules]
    sizes = " ".join(f"WHEN {k} THEN length(regexp_extract(hit, '{p}', {r.group}))" for k, r, p in rules)
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r, _ in rules)
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(kinds)}),
placed AS (
  SELECT doc_id, rank, kind, text, m, 0 AS k, 0::BIGINT AS s, 0::BIGINT AS e FROM found WHERE len(m) > 0
  UNION ALL
  SELECT doc_id, rank, kind, text, m, k + 1, e + strpos(substr(text, e + 1), m[k + 1]) - 1, e + strpos(substr(text, e + 1), m[k + 1]) - 1 + length(m[k + 1]) FROM placed WHERE k < len(m)),
spans AS (SELECT doc_id, rank, kind, s, kind || ':' || s || ':' || e AS span FROM (SELECT *, m[k] AS hit FROM placed WHERE k > 0) WHERE CASE rank {sizes} END >= CASE rank {least} END),
summed AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY s, rank) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN summed s ON t.doc_id = s.doc_id
"""


ORACLE_SQL["op1_secret_scan"] = _secrets_sql()


@query
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).cast("long").alias("taken"))


ORACLE_SQL["op2_source_mixing"] = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sizes GROUP BY source),
weighed AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM by_source),
ranked AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(s * 3) OVER (ORDER BY s::DOUBLE / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(w) OVER (ORDER BY s::DOUBLE / w, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_rest
  FROM weighed),
levels AS (SELECT max(rest::DOUBLE / w_rest) AS level FROM ranked WHERE rest * w <= s * 3 * w_rest),
goal AS (SELECT source, s, least((s * 3)::DOUBLE, level * w) AS target FROM ranked, levels),
passes AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS k FROM goal),
groups AS (SELECT source, h, sum(size)::BIGINT AS z, count(*) AS rows FROM sizes GROUP BY source, h),
summed AS (SELECT *, (sum(z) OVER (PARTITION BY source ORDER BY h) - z)::BIGINT AS before FROM groups)
SELECT a.doc_id, a.size, g.s AS source_size, g.target,
       (a.size * least(g.k, 3) + CASE WHEN g.k >= 3 THEN 0 WHEN c.before + c.z <= g.target - g.k * g.s THEN a.size
          ELSE greatest(floor((g.target - g.k * g.s - c.before) / c.rows), 0) END)::BIGINT AS taken
FROM sizes a JOIN passes g ON a.source IS NOT DISTINCT FROM g.source JOIN summed c ON a.source IS NOT DISTINCT FROM c.source AND a.h = c.h
"""


@query
def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures_of_pages(_table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    return found.select("record_id", "canonical", "resolution", "refers_to", headers.alias("headers"))


ORACLE_SQL["op3_warc_revisits"] = rf"""
WITH plain AS (SELECT coalesce(page_id::VARCHAR, 'null') AS name, 1700000000 + coalesce(page_id, 0) * 60 AS s, '"' || md5(coalesce(html, '')) || '"' AS tag, url,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS p FROM pages),
parts AS (SELECT *, regexp_extract(p, '^([^?]*)', 1) AS head, [x FOR x IN list_sort(string_split(regexp_extract(p, '^[^?]*\?(.*)$', 1), '&')) IF x <> '' AND NOT regexp_matches(x, '(?i)^{warc.TRACKING}(=|$)')] AS kept FROM plain),
named AS (SELECT name, s, tag, CASE WHEN url IS NOT NULL THEN regexp_replace(regexp_replace(lower(regexp_extract(head, '^([^/]*)', 1)), ':(80|443)$', ''), '^www\.', '')
  || regexp_replace(regexp_extract(head, '^[^/]*(.*)$', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM parts),
captures AS (SELECT 'response-' || name AS record_id, canonical, s, tag, true AS is_full FROM named UNION ALL SELECT 'revisit-' || name, canonical, s + 10800, 'W/' || tag, false FROM named),
based AS (SELECT *, max(CASE WHEN is_full THEN {{'s': s, 'id': record_id, 'tag': tag}} END) OVER (PARTITION BY canonical ORDER BY s, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM captures),
told AS (SELECT *, CASE WHEN canonical IS NULL THEN 'other' WHEN is_full THEN 'full' WHEN base IS NULL THEN 'no_earlier' WHEN 'W/' || base.tag = tag THEN 'resolved' ELSE 'validator_mismatch' END AS resolution FROM based)
SELECT record_id, canonical, resolution, CASE WHEN resolution IN ('resolved', 'validator_mismatch') THEN base.id END AS refers_to,
  'content-type=' || CASE WHEN is_full OR resolution = 'resolved' THEN 'text/html' ELSE 'text/plain' END || '; date=' || strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') || '; etag=' || tag AS headers
FROM told
"""


@query
def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each image: the queries (edited copies of the images whose id is divisible by 50; equal ones stand for
    each other under their smallest id) that show it."""
    vectors = _table(spark, sf_dir, "embeddings")
    images = image_copies.rendered(vectors, edited=False)
    asked = image_copies.rendered(vectors.where("vec_id % 50 = 0"))
    digest = lambda c: F.unhex(F.sha2(c, 256))
    found = image_copies.copies(images.select(F.col("original").alias("image")), asked.select(F.col("edited").alias("image")))
    names = asked.groupBy(digest("edited").alias("query_class")).agg(F.min("id").alias("query_id"))
    by_class = stored(found.join(names, "query_class").groupBy("class").agg(F.array_sort(F.collect_list("query_id")).alias("query_ids"), F.max("inliers").alias("inliers")), "classes")
    rows = images.select(F.col("id").alias("vec_id"), digest("original").alias("class")).join(by_class, "class", "left")
    return rows.select("vec_id", F.hex("class").alias("image_class"), F.coalesce(F.array_size("query_ids"), F.lit(0)).cast("long").alias("n_queries"), F.array_join("query_ids", ",").alias("query_ids"), F.coalesce("inliers", F.lit(0)).cast("long").alias("inliers"))


#: Fixed values.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


@query
def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_reputation.judged(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 9).alias("bad_rate"), F.round("bad_bound", 9).alias("bad_bound"))


def _reputation_sql() -> str:
    fits = lambda rule: (lambda own, start: f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{start}')")(*rule.split("/", 1))
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1]))
    named = " ".join(f"WHEN {fits(rule)} THEN '{rule}'" for _, rule in ordered)
    judged = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for verdict, rule in ordered)
    strength = lambda children, by: f"""SELECT {by}, n, bad, CASE WHEN k < 2 THEN 10.0 ELSE 1 / least(greatest(((q - n * p * p) / (p * (1 - p)) - k) / greatest(n - k, 1), 1 / 1001), 0.5) - 1 END AS m
  FROM (SELECT {by}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*) AS k, sum(bad * bad / n) AS q, (sum(bad) + 0.5) / (sum(n) + 1.0) AS p FROM {children} GROUP BY {by})"""  # noqa: E731
    second = "|".join(host_reputation.SECOND_LEVEL)
    part = lambda n: f"array_to_string(string_split(own, '.')[greatest(len(string_split(own, '.')) - {n - 1}, 1):], '.')"
    return rf"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
plain AS (SELECT *, CASE {named} END AS rule, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS own FROM parts),
suffixed AS (SELECT *, CASE WHEN regexp_matches(own, '^([0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}|\[.*\])$') THEN 'ip' WHEN regexp_matches(own, '(^|\.)({second})\.[a-z]{{2}}$') THEN {part(2)} ELSE {part(1)} END AS suffix FROM plain),
ruled AS (SELECT *, CASE WHEN suffix = 'ip' THEN own WHEN contains(suffix, '.') THEN {part(3)} ELSE {part(2)} END AS domain FROM suffixed),
hosts AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum((CASE rule {judged} END = 'block')::INT)::DOUBLE AS bad FROM ruled WHERE rule IS NOT NULL GROUP BY ALL),
domain_sums AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffix_sums AS (SELECT suffix, 1 AS everything, sum(n) AS n, sum(bad) AS bad FROM domain_sums GROUP BY suffix),
top AS (SELECT coalesce(max(bad) + 1.0, 1.0) AS a, coalesce(max(n) - max(bad) + 1.0, 1.0) AS b, coalesce(max(m), 10.0) AS m FROM ({strength("suffix_sums", "everything")})),
suffixes AS (SELECT c.suffix, c.m, bad + t.m * t.a / (t.a + t.b) AS a, n - bad + t.m * t.b / (t.a + t.b) AS b FROM ({strength("domain_sums", "suffix")}) c, top t),
domains AS (SELECT c.domain, c.m, c.bad + u.m * u.a / (u.a + u.b) AS a, c.n - c.bad + u.m * u.b / (u.a + u.b) AS b FROM ({strength("hosts", "domain")}) c JOIN domain_sums d ON c.domain = d.domain JOIN suffixes u ON d.suffix = u.suffix),
own AS (SELECT host, bad + u.m * u.a / (u.a + u.b) AS a, n - bad + u.m * u.b / (u.a + u.b) AS b FROM hosts h JOIN domains u ON h.domain = u.domain),
known AS (SELECT page_id, r.host, path, rule, coalesce(o.a, d.a, s.a, t.a) AS a, coalesce(o.b, d.b, s.b, t.b) AS b
  FROM ruled r LEFT JOIN own o ON r.host = o.host LEFT JOIN domains d ON r.domain = d.domain LEFT JOIN suffixes s ON r.suffix = s.suffix, top t),
shaped AS (SELECT *, greatest(b, 1.0) AS c, 1 / (9 * a) AS p, 1 / (9 * greatest(b, 1.0)) AS q FROM known),
squared AS (SELECT *, (1 - p) * (1 - p) - 1.645 * 1.645 * p AS low, (1 - p) * (1 - q) AS mid, (1 - q) * (1 - q) - 1.645 * 1.645 * q AS high FROM shaped),
rooted AS (SELECT *, greatest((mid - sqrt(mid * mid - low * high)) / high, 0.0) AS y FROM squared),
bounds AS (SELECT *, CASE WHEN a < 1 THEN 0.0 ELSE a * (y * y * y) / (a * (y * y * y) + c) END AS bound FROM rooted)
SELECT page_id, host, path, rule, coalesce(CASE rule {judged} END, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(a / (a + b), 9) AS bad_rate, round(bound, 9) AS bad_bound
FROM bounds
"""


ORACLE_SQL["op5_host_reputation"] = _reputation_sql()


@query
def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, _ = host_reputation.host_and_path(F.col("url"))
    found = html_main.extract(_table(spark, sf_dir, "pages"), ("page_id", "url"), host=host)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: All sets that share a shingle are compared in full.
ORACLE_SQL["op7_minhash_near_dedup"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM worded),
sets AS (SELECT min(doc_id) AS node, list_sort(s) AS s, len(s) AS n FROM shingled GROUP BY list_sort(s), len(s)),
terms AS (SELECT node, n, unnest(s) AS t FROM sets WHERE n > 0),
pairs AS (SELECT a.node AS x, b.node AS y FROM terms a JOIN terms b ON a.t = b.t AND a.node < b.node AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.node, a.n, b.node, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT node, node AS seen FROM sets WHERE n > 0 UNION SELECT r.node, e.y FROM reach r JOIN edges e ON r.seen = e.x),
component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM shingled d JOIN sets s ON list_sort(d.s) = s.s LEFT JOIN component c ON c.node = s.node
"""

@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # an id that is null has no fold: it is neither held out nor learned from
    model = language_id.train(docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out(F.col("doc_id"))))
    found = docs.select("doc_id", language_id.predictor(docs, model)(F.col("text")).alias("p"))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.bits").alias("bits"), F.col("p.rejected").alias("rejected"))


@query
def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    found = sharding.text_tree(_table(spark, sf_dir, "documents"), leaves=8, keep={"doc_id": F.col("doc_id"), "text_crc32": checksum}).slotted()
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=13)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE_SQL["op10_decontamination"] = r"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)),
met AS (SELECT doc_id, places.n, i, item_id FROM places JOIN windows ON places.n = windows.n AND places.p = windows.p),
hit AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM met)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM doc_words d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
