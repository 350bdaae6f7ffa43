"""Paragraphs that are part of a document's references: kept as they are, the others are sent on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_key(plain: Column) -> Column:
    """What is looked for of a squashed text: nothing below 12 characters, all up to 60, else 40 from a quarter on."""
    n = F.length(plain)
    return F.when(n < 12, F.lit(None)).when(n > 60, F.substr(plain, F.floor(n / 4).cast("int") + 1, F.lit(40))).otherwise(plain)


def in_references(plain: Column, section: Column) -> Column:
    return F.coalesce(F.contains(section, search_key(plain)), F.lit(False))


#: Keys have GRAM to WINDOW characters (see search_key); sections are cut into blocks of BLOCK first places.
GRAM, WINDOW, BLOCK = 12, 60, 4096


def containing(keys: DataFrame, sections: DataFrame, section: str, key: str = "k", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, section: each distinct search key with each section whose text contains it; with keep, these columns, key and
    section for each distinct row of them, which spares the way back from keys to rows.

    An equi-join in place of a comparison of all pairs: keys meet the blocks of a text that have the hash of their first GRAM
    characters at some place, of which only hash and block move, and stay if the block contains them. Null keys meet nothing."""
    asked = keys.where(F.col(key).isNotNull()).select(*keep, key)
    asked = (asked if keep else asked.distinct()).withColumn("gram", F.xxhash64(F.left(key, F.lit(GRAM))))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / BLOCK).cast("int")), lambda k: F.substr(F.col(text), k * BLOCK + 1, F.lit(BLOCK + WINDOW - 1)))
    blocks = sections.where(F.length(text) >= GRAM).select(section, F.posexplode(cut).alias("part", "block"))
    grams = F.transform(F.sequence(F.lit(1), F.least(F.length("block") - GRAM + 1, F.lit(BLOCK))), lambda k: F.xxhash64(F.substr(F.col("block"), k, F.lit(GRAM))))
    places = blocks.where(F.length("block") >= GRAM).select(section, "part", F.explode(F.array_distinct(grams)).alias("gram"))
    met = asked.join(places, "gram").select(*keep, key, section, "part").join(blocks, [section, "part"])
    return met.where(F.contains("block", F.col(key))).select(*keep, key, section).distinct()


def split_and_merge(rows: DataFrame, flag: str, send, key: str = "id") -> DataFrame:
    """Rows whose flag is true keep `input` as `output`; the others go through send (DataFrame to DataFrame with output)."""
    kept = rows.where(F.col(flag)).withColumn("output", F.col("input"))
    return kept.unionByName(send(rows.where(~F.coalesce(F.col(flag), F.lit(False)))), allowMissingColumns=True)
