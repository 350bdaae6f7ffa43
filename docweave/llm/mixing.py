"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash. A source that is to give k whole passes and a part of another takes its
documents k times, and once more where the hash lies below the source's threshold. The threshold is found without
sorting: words are summed by source and the top 10 bits of the hash, the bucket in which the budget ends is
found, and only the documents of that bucket are summed by the next 10 bits, until one document (or several of
the same hash) is left, which gives just the words that are missing. Thresholds nest: with a larger budget a source keeps
what it had. Histograms have at most 1024 rows a source and level, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import WORD, stored, words_counted

HASH_BITS, LEVEL_BITS = 60, 10


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits that depend on the row's id and text alone."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes: source, size. Returns source, source_size, target.

    Sources in code point order, null last, have the weights in turn. All words are shared by weight; no target
    exceeds `most` times its source's size, what is over is shared again by weight among the others. This is a water
    level: in the order of most * size / weight, sources are full as long as the level of the rest is above theirs.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("s"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("w", weight).withColumn("turn", turn)
    order = Window.orderBy(F.col("s").cast("double") / F.col("w"), "turn")
    ranked = ranked.withColumns({
        "rest": F.sum("s").over(Window.partitionBy()) - F.coalesce(F.sum(F.col("s") * most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "w_rest": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = F.when(F.col("rest") * F.col("w") <= F.col("s") * most * F.col("w_rest"), F.col("rest").cast("double") / F.col("w_rest"))
    level = F.max(level).over(Window.partitionBy())
    return ranked.select("source", F.col("s").alias("source_size"), F.least((F.col("s") * most).cast("double"), level * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size (words of the text, 0 for null), source_size, target, copies, part and h (the hash) of every row.

    The mix takes the row `copies` times and, of the document at the threshold, `part` words once more, `most` times the
    row's words at most. A source's words miss its target by less than one word; rows that agree in id and text have the same
    hash and share what is missing evenly, by less than a word for each of them. A source without words has target 0. Other
    columns are not looked at.
    """
    sizes = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_counted(F.col(text)).alias("size"), document_hash(F.col(doc_id), F.col(text)).alias("h")), "sizes")
    goal, copies, part = _thresholds(sizes, weights, most)
    rows = sizes.alias("a").join(goal.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    return rows.select("doc_id", "a.source", "size", "source_size", "target", copies(F.col("h")).alias("copies"), part(F.col("h")).alias("part"), "h")


def _thresholds(sizes: DataFrame, weights: tuple[int, ...], most: int):
    """A written table of source, source_size, target and its thresholds, and by a row of it the whole copies of a hash and the
    words that it gives besides."""
    passes = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    goal = stored(targets(sizes, weights, most).withColumn("passes", passes).withColumn("need", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    cut = goal.select("source", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("inside"))
    for bits in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        here = sizes.alias("a").join(cut.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.shiftright("h", HASH_BITS - bits + LEVEL_BITS) == F.col("prefix")))
        sums = here.groupBy(F.col("a.source").alias("source"), "need", "below", F.shiftright("h", HASH_BITS - bits).alias("bucket")).agg(F.sum("size").alias("inside"), F.count("*").alias("rows"))
        upto = F.sum("inside").over(Window.partitionBy("source").orderBy("bucket"))
        over = sums.withColumn("upto", F.col("below") + upto).where("upto > need")
        first = over.groupBy("source").agg(F.min(F.struct("bucket", "need", "upto", "inside", "rows")).alias("m")).select("source", "m.*")
        cut = stored(first.select("source", "need", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("inside")).alias("below"), "inside", "rows"), "cut")
        if (cut.agg(F.max("rows")).first()[0] or 0) <= 1:
            break
    cut = cut.select("source", "prefix", F.greatest(F.floor((F.col("need") - F.col("below")) / F.col("rows")), F.lit(0)).cast("long").alias("missing"), (F.col("inside") / F.col("rows")).alias("each"))
    goal = stored(goal.alias("a").join(cut.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "source_size", "target", "passes", "prefix", "missing", "each"), "goal")

    def copies(h: Column) -> Column:
        extra = F.when(F.shiftright(h, HASH_BITS - bits) < F.col("prefix"), 1).otherwise(0)
        return F.least(F.col("passes") + extra, F.lit(most)).cast("int")

    def part(h: Column) -> Column:
        at = (F.shiftright(h, HASH_BITS - bits) == F.col("prefix")) & (F.col("passes") < most)
        return F.when(at, F.col("missing")).otherwise(0).cast("long")

    return goal, copies, part


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, text: str = "text", doc_id: str = "doc_id", source: str = "source", cut: bool = False) -> DataFrame:
    """docs with each row as often as the mix takes it. Rows meet only the table of thresholds, a row for each source.

    Of the document at a source's threshold come, if `cut`, the words that are missing, parted by single spaces; else it comes
    whole if that is nearer to the target.
    """
    h = document_hash(F.col(doc_id), F.col(text))
    goal, copies, part = _thresholds(stored(docs.select(F.col(source).alias("source"), words_counted(F.col(text)).alias("size"), h.alias("h")), "sizes"), weights, most)
    own = goal.select(F.col("source").alias("__source"), "passes", "prefix", "missing", "each")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("__own"), h.alias("__h"))
    met = rows.join(own, F.col("__own").eqNullSafe(F.col("__source"))).withColumns({"copies": copies(F.col("__h")), "part": part(F.col("__h"))})
    if not cut:
        met = met.withColumn("copies", F.col("copies") + F.when(F.col("part") * 2 > F.col("each"), 1).otherwise(0))
    whole = met.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("time")).select("row.*")
    if not cut:
        return whole
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.{text}"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    return whole.unionByName(met.where("part > 0").select(F.col("row").withField(f"`{text}`", first).alias("row")).select("row.*"))
