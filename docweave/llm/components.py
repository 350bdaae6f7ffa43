"""Connected components of an edge table, by repeated joins; nothing of it comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b of any orderable type (undirected, repeats allowed). Returns node, root for every node
    of an edge; root is the component's smallest node. Nulls are not nodes.

    Large-star and small-star steps alternate (Kiveris et al. 2014) until every node hangs on one root.
    The smallest neighbours are written before they are joined, so both sides of the join are plain
    shuffles and a node with very many neighbours can be split among tasks.
    """
    scratch = Scratch(edges.sparkSession)
    found = scratch.stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(found):
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = scratch.stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = scratch.stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = scratch.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = stored(found.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), "roots")
    scratch.clear()
    return roots


def _stars(found: DataFrame) -> bool:
    ends = found.select(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(found.select(F.col("v").alias("n"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or (low > 0 and high > 0)").isEmpty()
