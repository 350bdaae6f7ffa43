"""Secret scanning with an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its content. The ledger, a Parquet table, has one row for
each blob and rule version that was scanned, with the findings. A scan takes the blobs that lack a row for some
rule version, scans one copy of each for just those rules, appends to the ledger, and joins findings back
to every path that has the blob.

Scale. What moves of a version is its hash and one bit a rule: whether its text shows a string that every match of
the rule has (looked for where the text is read). Only texts that show one are moved, map-side reduced to one copy a blob
and task, and searched in Python for the rules that show and that their blob lacks; the other pairs are clean. Paths are
joined on the hash alone, and only to blobs with findings, which are broadcast if they are few. Every rule's search is linear
in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import bounded_batches, fresh_dir

_SEGMENT = re.compile(r"[A-Za-z0-9_-]+")


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the jwt pattern, found run by run: the pattern itself starts anew at each eyJ of a long run."""
    runs: list[tuple[int, int]] = []
    for m in _SEGMENT.finditer(text):
        if runs and (m.start() != runs[-1][1] + 1 or text[runs[-1][1]] != "."):
            runs = []
        runs = [*runs[-2:], m.span()]
        if len(runs) == 3:
            (low, end), (second, stop), (_, last) = runs
            start = text.find("eyJ", low, end)
            if start >= 0 and end - start >= 11 and text.startswith("eyJ", second) and stop - second >= 11:
                yield start, last
                runs = []


@dataclass(frozen=True)
class Rule:
    """kind and version name the rule in the ledger; a changed rule needs another version. Matches of pattern count, leftmost
    first and not overlapping, if `group` has `least` characters; find gives the same spans where the pattern alone isn't
    linear. A text that matches has, in lower case, one of the hints or a match of screen (neither: any text may)."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()
    screen: str | None = None
    find: Callable[[str], Iterator[tuple[int, int]]] | None = None

    def may(self, low: Column) -> Column:
        """Whether the rule may match a text, given in lower case; evaluated where the text is read."""
        shown = [F.contains(low, F.lit(h)) for h in self.hints] + ([low.rlike(self.screen)] if self.screen else [])
        return reduce(lambda a, b: a | b, shown) if shown else F.lit(True)

    def spans(self, text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
        if self.find:
            return list(self.find(text))
        return [m.span() for m in pattern.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: Fixed values.
BASE_RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 24, screen="[0-9a-f]{24}"),  # the runs of [0-9a-f]+ that are long enough
)
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hints=("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=(".eyj",), find=web_tokens),
)
#: Findings of so many bytes, about, are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20
LEDGER = "blob binary, kind string, version int, spans array<struct<start:int,end:int>>"


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text") -> DataFrame:
    """Scans what the ledger (a path in storage that all nodes share; made if missing) lacks and appends it there.
    Returns versions with the columns blob and findings, an array of (kind, start, end) in code points by start, then
    in the order of rules.

    A null text is an empty one. Repeated rows stay. Columns named blob or findings are replaced. An empty table adds nothing.
    """
    spark = versions.sparkSession
    bounded_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    blob = F.unhex(F.sha2(body.cast("binary"), 256))
    seen = spark.read.schema(LEDGER).parquet(ledger) if _exists(spark, ledger) else spark.createDataFrame([], LEDGER)
    _append(versions.select(blob.alias("blob"), body.alias("text")), seen, rules, ledger)

    current = reduce(lambda a, b: a | b, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])
    found = spark.read.schema(LEDGER).parquet(ledger).where(current).where(F.size("spans") > 0)
    rank = reduce(lambda a, r: a.when(F.col("kind") == r[1].kind, r[0]), enumerate(rules), F.when(F.lit(False), -1))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind")))
    by_blob = found.withColumn("rank", rank).groupBy("blob").agg(F.array_distinct(F.array_sort(F.flatten(F.collect_list(spans)))).alias("f"))
    by_blob = by_blob.select("blob", F.transform("f", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("findings"))
    weight = by_blob.agg(F.sum(60 + 24 * F.size("findings"))).first()[0] or 0
    by_blob = F.broadcast(by_blob) if weight <= BROADCAST_BYTES else by_blob
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return versions.withColumn("blob", blob).drop("findings").join(by_blob, "blob", "left").withColumn("findings", F.coalesce("findings", none))


def _append(texts: DataFrame, seen: DataFrame, rules: tuple[Rule, ...], ledger: str) -> None:
    """texts: blob, text. Adds the pairs of a blob and a rule that seen lacks. Texts and what was seen meet in one aggregation by blob."""
    bits = lambda flags: reduce(lambda a, b: a.bitwiseOR(b), [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(flags)])
    # a function of one argument, or every hint would lower the text anew
    shows = F.transform(F.array(F.lower("text")), lambda low: bits([r.may(low) for r in rules]))[0]
    blobs = texts.withColumn("shows", shows).select("blob", "shows", F.when(F.col("shows") != 0, F.col("text")).alias("text"), F.lit(0).alias("has"))
    if not seen.isEmpty():
        has = bits([(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])
        blobs = blobs.unionByName(seen.select("blob", F.lit(None).cast("int").alias("shows"), F.lit(None).cast("string").alias("text"), has.alias("has")))
    todo = blobs.groupBy("blob").agg(F.max("shows").alias("shows"), F.first("text", ignorenulls=True).alias("text"), F.bit_or("has").alias("has"))
    lacks = F.lit((1 << len(rules)) - 1).bitwiseAND(F.bitwise_not("has"))
    todo = todo.where("shows is not null").withColumn("lacks", lacks).where("lacks <> 0")

    def search(batches):
        ready = [(1 << k, r, re.compile(r.pattern, re.ASCII | re.IGNORECASE * r.any_case)) for k, r in enumerate(rules)]
        for batch in batches:
            shows, lacks = (batch[c].to_numpy(zero_copy_only=False) for c in ("shows", "lacks"))
            texts = {int(k): batch["text"][int(k)].as_py() for k in np.flatnonzero(shows & lacks)}
            for bit, rule, pattern in ready:
                asked = np.flatnonzero(lacks & bit)
                found = [rule.spans(texts[k], pattern) if shows[k] & bit else [] for k in asked.tolist()]
                flat = np.array([x for own in found for x in own], np.int32).reshape(-1, 2)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
                n = len(asked)
                yield pa.record_batch([batch["blob"].take(pa.array(asked)), pa.array([rule.kind] * n, pa.string()), pa.array([rule.version] * n, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), spans)], ["blob", "kind", "version", "spans"])

    todo.select("blob", "shows", "lacks", "text").mapInArrow(search, LEDGER).write.mode("append").parquet(ledger)


def _exists(spark, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def fresh_ledger(spark) -> str:
    return fresh_dir(spark, "ledger")
