"""Replies of a model to a batch: a JSON array of {id, output}, perhaps fenced and with text around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import strip_fence

ROWS = "array<struct<id:variant,output:variant>>"


def parsed(reply: Column, ids: Column) -> Column:
    """struct(rows array<struct<id long, output string>>, error): what follows the first [ is read, text after the array is not. It must
    be an array of objects with a string as output and with the requested ids, each once; other keys are tolerated."""
    body = strip_fence(reply)
    value = F.try_parse_json(F.when(F.instr(body, "[") > 0, F.substr(body, F.instr(body, "["))))
    kind = F.schema_of_variant(value)
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    rows = F.transform(items, lambda v: F.struct(F.when(F.schema_of_variant(F.try_variant_get(v, "$.id", "variant")) == "BIGINT", F.try_variant_get(v, "$.id", "long")).alias("id"), F.when(F.schema_of_variant(F.try_variant_get(v, "$.output", "variant")) == "STRING", F.try_variant_get(v, "$.output", "string")).alias("output")))
    bad = F.exists(rows, lambda r: r["id"].isNull() | r["output"].isNull())
    error = F.when(rows.isNull(), F.lit("no array")).when(bad, F.lit("a row without id or output")).when(F.array_sort(F.transform(rows, lambda r: r["id"])) != F.array_sort(F.transform(ids, lambda i: i.cast("long"))), F.lit("other ids"))
    return F.struct(F.when(error.isNull(), F.array_sort(rows)).alias("rows"), error.alias("error"))


def encoded(rows: Column) -> Column:
    """A batch as JSON: an array of struct(id, input), by id."""
    return F.to_json(F.array_sort(rows))


def id_match(requested: DataFrame, replied: DataFrame, key: str) -> DataFrame:
    """key, status (ok, missing, extra or repeated) of every id on either side."""
    a = requested.groupBy(key).agg(F.count("*").alias("asked"))
    b = replied.groupBy(key).agg(F.count("*").alias("got"))
    how = F.when(F.col("got").isNull(), "missing").when(F.col("asked").isNull(), "extra").when((F.col("got") > 1) | (F.col("asked") > 1), "repeated").otherwise("ok")
    return a.join(b, key, "full_outer").select(key, how.alias("status"))


def strict_error(value: Column, ids: Column) -> Column:
    """What is wrong with a batch (JSON text, an array of objects): their number, repeated or other ids, or keys that are
    not just id and output; null if nothing is."""
    items = F.try_variant_get(F.try_parse_json(value), "$", "array<variant>")
    keys = F.transform(items, lambda v: F.array_sort(F.json_object_keys(F.to_json(v))))
    own = F.transform(items, lambda v: F.try_variant_get(v, "$.id", "long"))
    wanted = F.transform(ids, lambda i: i.cast("long"))
    error = F.when(items.isNull(), "no array").when(F.size(items) != F.size(ids), "another number of rows").when(F.size(F.array_distinct(own)) != F.size(own), "repeated ids")
    error = error.when(F.array_sort(own) != F.array_sort(wanted), "other ids")
    return error.when(F.exists(keys, lambda k: ~F.coalesce(k == F.array(F.lit("id"), F.lit("output")), F.lit(False))), "other keys")


def after_marker(prompt: Column, marker: str) -> Column:
    """What follows the marker's first occurrence, stripped; the whole prompt if it isn't there."""
    at = F.instr(prompt, marker)
    return F.when(at > 0, F.regexp_replace(F.substr(prompt, at + len(marker)), r"(?U)\A\s+|\s+\z", "")).otherwise(prompt)


INPUTS = "array<struct<id:bigint,input:string>>"


def embedded(prompt: Column, marker: str) -> Column:
    """The batch that a prompt has after the marker, as INPUTS; null if there is none or it is malformed: the prompt is then
    to be passed on as it is."""
    items = F.when(F.instr(prompt, marker) > 0, F.try_variant_get(F.try_parse_json(after_marker(prompt, marker)), "$", "array<variant>"))
    bad = F.exists(items, lambda v: F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.input", "variant")) != "STRING", F.lit(True)))
    rows = F.transform(items, lambda v: F.struct(F.try_variant_get(v, "$.id", "long").alias("id"), F.try_variant_get(v, "$.input", "string").alias("input")))
    return F.when(~bad, rows)


def merged(reply: Column, kept: Column) -> Column:
    """reply (JSON rows) and kept (array of struct(id, output)) as JSON by id; a malformed reply stays as it is."""
    rows = F.try_variant_get(F.try_parse_json(reply), "$", "array<struct<id:bigint,output:string>>")
    bad = rows.isNull() | F.exists(rows, lambda r: r["id"].isNull() | r["output"].isNull())
    return F.when(bad, reply).otherwise(F.to_json(F.array_sort(F.concat(rows, kept))))
