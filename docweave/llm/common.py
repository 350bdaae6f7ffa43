"""Things the corpus operators share: written tables, column names and batches."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share: spark.checkpoint.dir, or where it is unset and all runs in one process (tests) a local
    one, which goes when Python ends. RuntimeError on a cluster that names none."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all nodes share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="docweave-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + os.path.abspath(_LOCAL[0])


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docweave-{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Batches to Python hold at most 1000 rows or 8 MB (one row at least), for the session: long texts in batches of
    the default 10,000 rows take hundreds of MB in each worker and as much beside the heap. A smaller setting stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key, None)
        size = int(now) if now and now.lstrip("-").isdigit() else 0
        if size <= 0 or size > most:
            spark.conf.set(key, str(most))


_WRITTEN: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: the lineage ends there, and a lost executor
    costs only a reread. Its size is then known to the planner too. The table stays until clear_stored()."""
    path = fresh_dir(df.sparkSession, name)
    if not _WRITTEN:
        atexit.register(clear_stored)
    _WRITTEN.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored() -> None:
    """Deletes what stored() wrote: to be called when the results that read it are written, and called when Python ends."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Written tables that an operator needs only until its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_dir(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


WORD = r"[^\x20\x09-\x0D]+"


def words_counted(text: Column, pattern: str = WORD) -> Column:
    """How often pattern occurs in text, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def spans_of_rows(offsets: np.ndarray, most: int):
    """(first, end) of runs of rows that hold at most `most` bytes together; a larger row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end
        first = end


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offset of each row; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets
