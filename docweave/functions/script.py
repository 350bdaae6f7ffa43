"""Chinese output in the script that a target language wants."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The transliteration that a target needs; other targets pass through.
CONVERSIONS = {"zh-TW": "Simplified-Traditional", "zh-CN": "Traditional-Simplified"}
HAN = (0x3400, 0x9FFF)


@cache
def _table(transform: str) -> tuple[str, str]:
    """Characters and what they become, one for one, as the ICU library that Spark ships has them. Its few rules that look at
    neighbours are not kept."""
    jvm = SparkSession.active()._jvm
    convert = jvm.com.ibm.icu.text.Transliterator.getInstance(transform)
    own = [chr(c) for c in range(HAN[0], HAN[1] + 1)]
    made = convert.transliterate("\n".join(own)).split("\n")
    pairs = [(a, b) for a, b in zip(own, made, strict=True) if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def convert_script(c: Column, target: str) -> Column:
    """c in the target's script; null stays null. The table is built once on the driver, rows stay in the JVM."""
    if target not in CONVERSIONS:
        return c
    return F.translate(c, *_table(CONVERSIONS[target]))
