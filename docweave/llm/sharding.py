"""K-d tree partitioning into leaves of equal bytes, with DataFrame operations only.

A node that has to give n leaves is cut into n // 2 and the rest, at the weighted quantile of its bytes along its
widest dimension (widths relative to the whole table's). The quantile is found by histograms: bytes are summed
by node and 12 bits of the coordinate, then by the next 12 bits within the bucket in which the cut lies, until that bucket is
lighter than `tolerance` of the node or has a single coordinate. What the driver sees is one row per node and
level. Rows of equal coordinate and equal text hash lie together; only a group of them that is heavier than the tolerance
and lies on the cut is divided, by a hash of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import stored

KEY_BITS, STEP_BITS = 60, 12


class Tree:
    """The cuts of a k-d tree, level by level; what they need of a row are its dimensions, group and tie."""

    def __init__(self, docs: DataFrame, size: Column, dimensions: dict[str, Column], group: Column, tie: Column, leaves: int | None = None, target_bytes: int | None = None, tolerance: float = 0.0005, keep: dict[str, Column] | None = None):
        hashed = lambda c, seed: F.shiftright(F.xxhash64(c, F.lit(seed)).bitwiseAND(F.lit(2**63 - 1)), 63 - KEY_BITS)
        self.names = [f"d{k}" for k in range(len(dimensions))]
        self.keys = {n: d.cast("double") for n, d in zip(self.names, dimensions.values(), strict=True)} | {"g": hashed(group, 1), "t": hashed(tie, 2), "node": F.lit(1).cast("long")}
        kept = {f"k{k}": c for k, c in enumerate((keep or {}).values())}
        rows = docs.select(*[c.alias(n) for n, c in (kept | {"size": size.cast("long")} | self.keys).items()])
        rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
        whole = rows.agg(F.sum("size").alias("total"), *[f(n).alias(f"{f.__name__}_{n}") for n in self.names for f in (F.min, F.max)]).first()
        if leaves is None:
            leaves = max(1, -(-(whole["total"] or 0) // target_bytes))
        width = {n: (whole[f"max_{n}"] or 0) - (whole[f"min_{n}"] or 0) for n in self.names}
        todo, first = {1: leaves}, {1: 0}
        self.shards, self.levels = {}, []
        while True:
            self.shards |= {n: first[n] for n, k in todo.items() if k == 1}
            todo = {n: k for n, k in todo.items() if k > 1}
            level = _cuts(rows, todo, self.names, width, tolerance) if todo else []
            if not level:  # no rows: nothing is cut any more
                break
            self.levels.append(level)
            rows = stored(_apply(rows, level, self.names), "rows")
            first |= {2 * n + c: first[n] + c * (k // 2) for n, k in todo.items() for c in (0, 1)}
            todo = {2 * n + c: k // 2 if c == 0 else k - k // 2 for n, k in todo.items() for c in (0, 1)}
        self.rows, self.kept = rows, dict(zip(kept, keep or {}, strict=True))

    def _numbers(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df.sparkSession.createDataFrame([*self.shards.items(), (0, 0)], "node long, shard int"))  # a row per leaf

    def slotted(self) -> DataFrame:
        """The keep columns, size, shard and slot of every row."""
        return _slots(self.rows.join(self._numbers(self.rows), "node")).select(*[F.col(k).alias(n) for k, n in self.kept.items()], "size", "shard", "slot")

    def assigned(self, docs: DataFrame) -> DataFrame:
        """docs (as given, or rows like them) with their shard, which replaces a column of that name. Rows meet the cuts
        only, a few for each leaf; they aren't shuffled."""
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"]).alias("row")
        rows = docs.select(row, *[c.alias(n) for n, c in self.keys.items()])
        for level in self.levels:
            rows = _apply(rows, level, self.names)
        return rows.join(self._numbers(docs), "node").select("row.*", "shard")


#: node, dim, low and width make the key; the rest says which keys go left.
CUT = "node long, dim int, low double, width double, prefix long, shift int, also boolean, t_prefix long, t_shift int, t_also boolean"


def _key() -> Column:
    """20 bits of the coordinate, then 40 of the group; null in nodes that aren't cut."""
    return F.expr("shiftleft(least(cast(floor((coalesce(value, low) - low) / width * 1048575) as bigint), 1048575), 40)") + F.shiftright("g", KEY_BITS - 40)


def _value(names: list[str]) -> Column:
    return F.coalesce(*[F.when(F.col("dim") == k, F.col(n)) for k, n in enumerate(names)])


def _cuts(rows: DataFrame, todo: dict[int, int], names: list[str], whole: dict[str, float], tolerance: float) -> list[tuple]:
    """A row of CUT for each node of todo (node: leaves to make) that has rows."""
    spark = rows.sparkSession
    nodes = F.broadcast(spark.createDataFrame([(n,) for n in todo], "node long"))  # at most as many as leaves
    stats = rows.join(nodes, "node").groupBy("node").agg(F.sum("size").alias("total"), *[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).collect()
    if not stats:
        return []
    plan = {}
    for s in stats:
        width = {n: ((s[f"max_{n}"] or 0) - (s[f"min_{n}"] or 0)) / whole[n] if whole[n] else 0.0 for n in names}
        d = max(names, key=lambda n: width[n])
        low, n = float(s[f"min_{d}"] or 0), s["node"]
        plan[n] = (n, names.index(d), low, float(s[f"max_{d}"] or 0) - low or 1.0, s["total"] * (todo[n] // 2) / todo[n], float(s["total"]))
    how = F.broadcast(spark.createDataFrame(list(plan.values()), "node long, dim int, low double, width double, need double, total double"))
    placed = rows.join(how, "node").withColumn("value", _value(names)).withColumn("key", _key()).select("node", "need", "total", "size", "key", "t")
    found = _quantiles(placed, "key", tolerance)
    heavy = [(n, c["prefix"], c["need"] - c["below"]) for n, c in found.items() if c["single"] and c["inside"] > tolerance * c["total"]]
    ties = {}
    if heavy:
        within = F.broadcast(spark.createDataFrame(heavy, "node long, hot long, rest double"))
        ties = _quantiles(placed.join(within, "node").where("key = hot").drop("need").withColumnRenamed("rest", "need"), "t", tolerance)
    out = []
    for n, c in found.items():
        t = ties.get(n)
        last = (None, None, None) if t is None else (t["prefix"], t["shift"], t["need"] - t["below"] >= t["inside"] / 2)
        out.append((*plan[n][:4], c["prefix"], c["shift"], c["need"] - c["below"] >= c["inside"] / 2, *last))
    return out


def _apply(rows: DataFrame, level: list[tuple], names: list[str]) -> DataFrame:
    """rows with the node that they go to."""
    cut = F.broadcast(rows.sparkSession.createDataFrame(level, CUT))  # a row per node
    side = rows.join(cut, "node", "left").withColumn("value", _value(names)).withColumn("key", _key())
    own, tied = F.expr("shiftright(key, shift)"), F.expr("shiftright(t, t_shift)")
    on_cut = F.when(F.col("t_prefix").isNull(), F.col("also")).otherwise((tied < F.col("t_prefix")) | ((tied == F.col("t_prefix")) & F.col("t_also")))
    left = (own < F.col("prefix")) | ((own == F.col("prefix")) & on_cut)
    node = F.when(F.col("prefix").isNull(), F.col("node")).when(left, F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
    return side.select(*[c for c in rows.columns if c != "node"], node.alias("node"))


def _quantiles(rows: DataFrame, key: str, tolerance: float) -> dict[int, dict]:
    """For each node the bucket of keys in which its first `need` bytes end: prefix (key >> shift), the bytes below and
    inside, and whether it is a single key."""
    spark, found, at = rows.sparkSession, {}, rows.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
    for bits in range(STEP_BITS, KEY_BITS + 1, STEP_BITS):
        shift = KEY_BITS - bits
        here = at.where(F.shiftright(key, shift + STEP_BITS) == F.col("prefix"))
        sums = here.groupBy("node", "need", "total", "below", F.shiftright(key, shift).alias("bucket")).agg(F.sum("size").alias("inside"), F.min(key).alias("low"), F.max(key).alias("high"))
        upto = F.col("below") + F.sum("inside").over(Window.partitionBy("node").orderBy("bucket"))
        over = sums.withColumn("upto", upto).where("upto >= need").groupBy("node").agg(F.min(F.struct("bucket", "need", "total", "upto", "inside", "low", "high")).alias("m"))
        now = {r["node"]: {"prefix": r["m"]["bucket"], "shift": shift, "need": r["m"]["need"], "total": r["m"]["total"], "inside": r["m"]["inside"], "below": r["m"]["upto"] - r["m"]["inside"], "single": r["m"]["low"] == r["m"]["high"], "low": r["m"]["low"]} for r in over.collect()}  # a row per node
        found |= now
        for c in now.values():
            if c["single"]:
                c |= {"prefix": c["low"], "shift": 0}
        more = [(n, c["prefix"], c["below"]) for n, c in now.items() if not c["single"] and c["inside"] > tolerance * c["total"]]
        if not more:
            break
        at = rows.join(F.broadcast(spark.createDataFrame(more, "node long, prefix long, below long")), "node")
    return found


def _slots(rows: DataFrame) -> DataFrame:
    """slot: gapless numbers in each shard. Rows are numbered within shard and written part (of bounded size, whatever
    the keys), and moved by the number of rows that the shard has in the parts before."""
    part = rows.withColumn("part", F.shiftright("uid", 33))
    counts = part.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = stored(counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).select("shard", "part", "before"), "before")
    numbered = part.withColumn("own", F.row_number().over(Window.partitionBy("shard", "part").orderBy("uid")))
    return numbered.join(before, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("own") - 1).cast("long")).drop("part", "own", "before")


def text_tree(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> Tree:
    """A tree over what a text shows of itself, so that equal texts are equal in every dimension: the logarithm of its bytes, its
    bytes per character (script), its characters per blank (words) and the logarithm of its bytes per line. A null text is
    an empty one; size is the bytes plus 1. options: see Tree.

    Rows of equal text share a leaf where balance allows; those that don't are divided by a hash of the id, and rows that
    agree in the id too are one. leaves, or target_bytes, of which as many leaves are made as needed (1 for an empty table).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(body) + 1).cast("long")
    without = lambda c: F.length(F.replace(body, F.lit(c), F.lit("")))
    shape = {
        "log_bytes": F.log2(size),
        "wide": F.octet_length(body) / F.greatest(F.length(body), F.lit(1)),
        "words": F.length(body) / (F.length(body) - without(" ") + 1),
        "lines": F.log2(size / (F.length(body) - without("\n") + 1)),
    }
    return Tree(docs, size, shape, body, F.col(doc_id), **options)
