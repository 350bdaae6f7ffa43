"""A reference library's items, and the small things around it: page lists, keys and file URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = r"\A[A-Z0-9]{8}\z"


def page_numbers(spec: Column, count: Column) -> Column:
    """Sorted distinct pages of a list like 1,3-5; null means all. An error for anything else, and for pages that aren't there."""
    parts = F.split(spec, ",")
    low = lambda p: F.regexp_extract(p, r"\A\s*(\d+)(?:-(\d+))?\s*\z", 1)
    high = lambda p: F.regexp_extract(p, r"\A\s*(\d+)(?:-(\d+))?\s*\z", 2)
    ranges = F.transform(parts, lambda p: F.struct(F.try_to_number(low(p), F.lit("999999999")).cast("int").alias("a"), F.coalesce(F.try_to_number(F.nullif(high(p), F.lit("")), F.lit("999999999")), F.try_to_number(low(p), F.lit("999999999"))).cast("int").alias("b")))
    bad = F.exists(ranges, lambda r: r["a"].isNull() | (r["a"] < 1) | (r["b"] < r["a"]) | (r["b"] > count))
    some = F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["a"], r["b"])))))
    return F.when(spec.isNull(), F.sequence(F.lit(1), count)).when(bad, F.raise_error(F.concat(F.lit("no such pages: "), spec))).otherwise(some)


def item_key(raw: Column) -> Column:
    key = F.upper(raw)
    return F.when(key.rlike(KEY), key).otherwise(F.raise_error(F.concat(F.lit("not an item key: "), raw)))


def local_path(url: Column) -> Column:
    """The path of a file URL on this machine; null for any other. A + stays a +."""
    ok = (F.parse_url(url, F.lit("PROTOCOL")) == "file") & F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit("")).isin("", "localhost") & ~url.rlike("[?#]")
    return F.when(ok, F.url_decode(F.replace(F.parse_url(url, F.lit("PATH")), F.lit("+"), F.lit("%2B"))))


def search_rows(items: DataFrame) -> DataFrame:
    """items: key, date, title, creators array<struct<lastName, name>>. Returns key, date, title, creators: the first three names."""
    names = F.transform(F.slice("creators", 1, 3), lambda c: F.coalesce(F.nullif(c["lastName"], F.lit("")), F.nullif(c["name"], F.lit("")), F.lit("")))
    return items.select("key", "date", "title", F.array_join(names, ", ").alias("creators"))


def _asked(items: DataFrame, keys: DataFrame) -> DataFrame:
    """asked, top: each key's item, or its parent if the key is a child's. A file without a parent is an error."""
    alone = F.col("parent").isNull() & F.col("content_type").isNotNull()
    top = F.when(alone, F.raise_error(F.concat(F.lit("an attachment that belongs to no item: "), F.col("key")))).otherwise(F.coalesce("parent", "key"))
    return keys.join(items.select("key", "parent", "content_type"), "key").select(F.col("key").alias("asked"), top.alias("top"))


def _files(items: DataFrame) -> DataFrame:
    return items.where("content_type = 'application/pdf' and parent is not null").select(F.col("parent").alias("top"), "key", "filename")


def attachments(items: DataFrame, keys: DataFrame) -> DataFrame:
    """asked, key, filename: the PDF children of each key's item, or of its parent if the key is a child's."""
    return _asked(items, keys).join(_files(items), "top").select("asked", "key", "filename")


def attachment_sets(items: DataFrame, keys: DataFrame) -> DataFrame:
    """asked, n, digest: how many PDFs attachments() finds for each key, and SHA-256 of their sorted file names, one a line. Files meet by
    parent before they meet keys, so an item with very many children costs no more than they are."""
    by_item = _files(items).groupBy("top").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("filename")), "\n"), 256).alias("digest"))
    found = _asked(items, keys).join(by_item, "top", "left")
    return found.select("asked", F.coalesce("n", F.lit(0)).alias("n"), "digest")
