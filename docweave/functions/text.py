"""Text expressions. Patterns that must mean the same in Java as in the rules spell out what a word character is."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: An ASCII word boundary; Java's own takes letters of other scripts for word characters.
BOUND = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
DENSE = r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]"
#: Fixed values, in the order in which they apply: what symbol fonts leave in the text layer.
SYMBOL_REPAIRS = [
    ("ﬁ", "fi"),
    ("ﬂ", "fl"),
    (r"\x01(?=C\b)", "°"),
    (r"[\x00-\x08\x0b-\x1f]", ""),
    ("ð", "("),
    ("Þ", ")"),
    ("¼", "="),
    ("þ", "+"),
    ("⁄", "/"),
    (r"(?<== )\)(?=\d)", "−"),
    (r"\b(cm|km|mm|m|s|yr|mol|kg|g|K)\)(?=\d)", "$1−"),
]


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def strip_fence(c: Column) -> Column:
    """Without a code fence around it."""
    return F.regexp_replace(c, r"(?U)\A```(?:json)?\s*|\s*```\z", "")


@F.arrow_udf(StringType())
def nfkc(column: pa.Array) -> pa.Array:
    """pyarrow's own function leaves characters decomposed, and is slower."""
    if pc.all(pc.string_is_ascii(column), skip_nulls=True).as_py() is not False:
        return column
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in column.to_pylist()], pa.string())


def squash(c: Column) -> Column:
    """Lower-case ASCII letters and digits only, placeholders and tags taken out first."""
    return F.regexp_replace(F.lower(nfkc(F.regexp_replace(c, r"\{v[0-9]+\}|<[^>]+>", " "))), "[^a-z0-9]", "")


def repair_symbols(c: Column) -> Column:
    """struct(text, n): the repairs applied in turn, and how many there were in all."""
    one = lambda p, by: lambda x: F.struct(F.regexp_replace(x["text"], f"(?U){p}", by).alias("text"), (x["n"] + F.regexp_count(x["text"], F.lit(f"(?U){p}"))).alias("n"))
    return reduce(lambda own, r: bound(own, one(*r)), SYMBOL_REPAIRS, F.struct(c.alias("text"), F.when(c.isNotNull(), 0).alias("n")))


def bound(value: Column, f) -> Column:
    """f(value), where value is evaluated once however often f has it, in its lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dense_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(DENSE))


def is_prose(c: Column) -> Column:
    """15 letters of a script without spaces, or 40 others: a translation must then differ."""
    dense = dense_letters(c)
    return (dense >= 15) | (F.regexp_count(c, F.lit(r"\p{L}")) - dense >= 40)


def escape_html(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def inline_jpeg(c: Column) -> Column:
    """A data URL of a binary column, without the line breaks that base64 puts in."""
    return F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(c), "[\r\n]", ""))


def shown(c: Column, most: int = 80) -> Column:
    """The first `most` characters, cut before they are escaped."""
    return escape_html(F.left(c, F.lit(most)))


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.left(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), F.lit(48)), F.lit("")), F.lit("paper"))
