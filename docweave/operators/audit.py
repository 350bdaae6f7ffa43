"""Gates and audits of a job: what failed, what was left out, whether a model or its files changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed_batches(rows: DataFrame, batch: str, checks: str = "checks") -> DataFrame:
    """One row: n_failed, batches (sorted ids of those with a row that neither passed nor was left untranslated by rule)."""
    bad = rows.where(~F.coalesce(F.col(checks), F.lit("not translated")).isin("passed", "not translated")).select(batch).distinct()
    return bad.agg(F.count("*").alias("n_failed"), F.array_sort(F.collect_list(batch)).alias("batches"))


def gates(rows: DataFrame, output: str = "output", checks: str = "checks") -> DataFrame:
    """One row: any_output, any_error; both false for no rows."""
    return rows.agg(F.coalesce(F.bool_or(F.col(output) != ""), F.lit(False)).alias("any_output"), F.coalesce(F.bool_or(F.col(checks).startswith("error") | F.col(checks).startswith("failed")), F.lit(False)).alias("any_error"))


def required(rows: DataFrame, lenient: bool = False) -> None:
    """Raises if nothing has output, or, unless lenient, if anything failed."""
    found = gates(rows).first()
    if not found["any_output"]:
        raise RuntimeError("nothing was translated")
    if found["any_error"] and not lenient:
        raise RuntimeError("some rows failed their checks")


def review_failures(rows: DataFrame, checks: str = "checks") -> DataFrame:
    """The rows of a model stage that did not pass and were not left out by rule, with what was drafted and revised."""
    kind = F.substring_index(checks, ":", 1)
    told = rows.where(~F.coalesce(F.col(checks), F.lit("passed")).isin("passed", "not translated"))
    return told.withColumns({"kind": kind, "reason": F.ltrim(F.expr(f"substr({checks}, length(substring_index({checks}, ':', 1)) + 2)"))})


def drift(recorded: Column, current: Column) -> Column:
    """Sorted names of the current facts (a map) that the recorded ones do not have with the same value."""
    return F.array_sort(F.filter(F.map_keys(current), lambda k: ~F.coalesce(recorded[k] == current[k], recorded[k].isNull() & current[k].isNull() & F.map_contains_key(recorded, k), F.lit(False))))


def missing_files(index: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """Names that an index lists and that are not there."""
    return index.select(name).distinct().join(present.select(name), name, "left_anti")


def ordered_digest(files: DataFrame, by: list[str], order: str, digest: str, size: str) -> DataFrame:
    """by, digest, n_bytes: SHA-256 of each group's digests in order of their names, and the sum of the sizes."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(digest).alias("d")))), lambda s: s["d"]), "")
    return files.groupBy(*by).agg(F.sha2(joined, 256).alias("digest"), F.sum(size).cast("long").alias("n_bytes"))


def legal_options(source_lang: str, target_lang: str, form: str = "pages", bilingual: bool = False, engine: str = "command", remote_host: str | None = None) -> None:
    """Raises ValueError for options that do not go together."""
    if source_lang == target_lang:
        raise ValueError("source and target are the same language")
    if (source_lang, target_lang) != ("en", "zh-TW") and form != "pages":
        raise ValueError("other languages are for reading pages only")
    if bilingual and form == "pages":
        raise ValueError("reading pages are bilingual already")
    if remote_host and engine != "http":
        raise ValueError("a remote host is for the HTTP engine only")
