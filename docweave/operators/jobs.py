"""Jobs addressed by their settings: the same settings and source give the same folder, which is written once."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def check_histogram(rows: DataFrame, checks: str = "checks") -> DataFrame:
    """status (what comes before the first colon), n."""
    return rows.groupBy(F.substring_index(checks, ":", 1).alias("status")).agg(F.count("*").alias("n"))


def publish(df: DataFrame, root: str, label: str, config: dict) -> str:
    """Writes df to root/label-hash and returns the path; a finished result of the same settings is left as it is. It is
    written beside and renamed, so a reader never sees half of it."""
    spark = df.sparkSession
    target = f"{root.rstrip('/')}/{label}-{config_hash(config)}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(target)):
        if not fs.exists(path(f"{target}/_SUCCESS")):
            raise FileExistsError(target)
        return target
    beside = f"{root.rstrip('/')}/.{label}-{config_hash(config)}.part"
    df.write.mode("overwrite").parquet(beside)
    if not fs.rename(path(beside), path(target)):
        raise FileExistsError(target)
    return target


def publish_job(tables: dict[str, DataFrame], root: str, label: str, config: dict) -> str:
    """Writes a job's tables (rows, skipped, manifest, ...), each to a folder of its name in root/label-hash, and returns that path. They are
    written beside it and renamed together; a finished job of the same settings is left as it is."""
    spark = next(iter(tables.values())).sparkSession
    target, path = f"{root.rstrip('/')}/{label}-{config_hash(config)}", spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(target)):
        beside = f"{root.rstrip('/')}/.{label}-{config_hash(config)}.part"
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{beside}/{name}")
        if not fs.rename(path(beside), path(target)):
            raise FileExistsError(target)
    return target


def read_job(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """A published job's tables by name, the manifest always with them. FileNotFoundError where one is missing, ValueError if the
    manifest's settings are not those that the folder is named by."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in {"manifest", *names}:
        if not fs.exists(place(f"{path}/{name}/_SUCCESS")):
            raise FileNotFoundError(f"{path}/{name}")
    found = {name: spark.read.parquet(f"{path}/{name}") for name in {"manifest", *names}}
    own = found["manifest"].first()["config_hash"]
    if not path.rstrip("/").endswith(f"-{own}"):
        raise ValueError(f"{path} holds a job of other settings: {own}")
    return found


def manifest(spark: SparkSession, config: dict, histogram: DataFrame, **facts: str | int | float | list[str] | list[int] | None) -> DataFrame:
    """One row: config_hash, config_json, checks (a map), n_rows, and a column for each fact (source, source_sha256, selected_pages, seconds,
    references_page, warnings or whatever a caller records)."""
    whole = histogram.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("checks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return whole.select(F.lit(config_hash(config)).alias("config_hash"), F.lit(json.dumps(config, sort_keys=True, ensure_ascii=False)).alias("config_json"), "checks", "n_rows", *[F.lit(v).alias(k) for k, v in facts.items()])
