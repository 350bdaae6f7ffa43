"""Glossary terms: parsing a glossary, and protecting, restoring, counting and rejoining terms in text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import BOUND, bound, strip, strip_tags
from docweave.functions.tokens import multiset_of


@dataclass(frozen=True)
class Term:
    text: str
    token: str
    banned: tuple[str, ...] = ()

    @property
    def acronym(self) -> bool:
        return self.text.isupper()

    @property
    def pattern(self) -> str:
        """The term between ASCII word boundaries. Where it begins with a word character that is looked for first, for
        a boundary that is tried at every place of a text takes several times as long."""
        flag, own = "" if self.acronym else "(?i)", _quoted(self.text)
        if WORD.fullmatch(self.text[0]) and WORD.fullmatch(self.text[-1]):
            return f"{flag}{own[0]}(?<![A-Za-z0-9_].){own[1:]}(?![A-Za-z0-9_])"
        return flag + BOUND + own + BOUND

    def may(self, c: Column, low: Column) -> Column:
        """False only where the term cannot be; low is c in lower case."""
        return F.contains(c, F.lit(self.text)) if self.acronym else F.contains(low, F.lit(self.text.lower())) | F.lit(not self.text.isascii())


WORD = re.compile("[A-Za-z0-9_]")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c if ord(c) < 128 else c for c in text)


def _replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def terms_of(names, banned=None) -> list[Term]:
    return [Term(t, "{v%d}" % (1_000_000 + k), tuple((banned or {}).get(t, ()))) for k, t in enumerate(dict.fromkeys(names))]


def longest_first(terms: list[Term]) -> list[Term]:
    return sorted(terms, key=lambda t: -len(t.text))


def has_token(c: Column, terms: list[Term]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(c, F.lit(t.token))
    return found


def replaced(c: Column, terms: list[Term]) -> Column:
    """The longest terms first, each in the whole text; a term that the text cannot have costs no pass over it."""

    def each(own: Column) -> Column:
        one = lambda t: lambda x: F.when(t.may(own["text"], own["low"]), F.regexp_replace(x, t.pattern, _replacement(t.token))).otherwise(x)
        return reduce(lambda out, t: bound(out, one(t)), longest_first(terms), own["text"])

    return bound(F.struct(c.alias("text"), F.lower(c).alias("low")), each) if terms else c


def protect(c: Column, terms: list[Term]) -> Column:
    """Terms replaced by their tokens, the longest first; an error if a token is there already."""
    return F.when(has_token(c, terms), F.raise_error(F.lit("the text has a glossary token already"))).otherwise(replaced(c, terms))


def restore(c: Column, terms: list[Term]) -> Column:
    for t in terms:
        c = F.replace(c, F.lit(t.token), F.lit(t.text))
    return c


def term_counts(c: Column, terms: list[Term]) -> Column:
    """map of term to its count, of those that occur outside tags."""

    words = [t for t in terms if all(map(WORD.fullmatch, t.text))]
    # terms of one word are found in one pass, whichever they are: no word is two of them but for its letters' case
    any_word = f"(?i)(?=[{''.join(sorted({t.text[0].lower() for t in words}))}])(?<![A-Za-z0-9_])({'|'.join(sorted({t.text.lower() for t in words}, key=len, reverse=True))})(?![A-Za-z0-9_])"

    def counted(own: Column) -> Column:
        plain, low = own["plain"], own["low"]
        found = F.regexp_extract_all(plain, F.lit(any_word), F.lit(1)) if words else F.array().cast("array<string>")
        maps = bound(found, lambda f: F.struct(multiset_of(f).alias("exact"), multiset_of(F.transform(f, lambda w: F.lower(w))).alias("folded")))

        def of(t: Term, m: Column) -> Column:
            if t in words:
                return F.coalesce(m["exact"][t.text] if t.acronym else m["folded"][t.text.lower()], F.lit(0))
            return F.when(t.may(plain, low), F.regexp_count(plain, F.lit(t.pattern))).otherwise(0)

        return bound(maps, lambda m: F.map_from_arrays(F.array(*[F.lit(t.text) for t in terms]), F.array(*[of(t, m) for t in terms])))

    if not terms:
        return F.create_map().cast("map<string,int>")
    plain = bound(strip_tags(c), lambda x: F.struct(x.alias("plain"), F.lower(x).alias("low")))
    return F.map_filter(bound(plain, counted), lambda k, v: v > 0)


def normalize(c: Column, terms: list[Term]) -> Column:
    """Terms that line breaks or hyphens tore apart, in their canonical spelling; acronyms are left alone."""
    for t in longest_first([t for t in terms if not t.acronym]):
        gap, words = r"(?:[ \t]*|-\s+)", [w for w in re.split(r"\s+", t.text) if w]
        begins = WORD.fullmatch(words[0][0])
        own = r"\s+".join(gap.join(map(_quoted, w)) for w in words)
        # looking for a letter first is faster than for a boundary
        pattern = f"{_quoted(words[0][0])}(?<![A-Za-z0-9_].){own[len(_quoted(words[0][0])):]}" if begins else BOUND + own
        c = F.regexp_replace(c, "(?i)" + pattern + BOUND, _replacement(t.text))
    return c


def parse_glossary(lines: DataFrame) -> DataFrame:
    """lines: line_no, line. Returns ord, term, token, banned, is_acronym: a line is `term # comment` or
    `term | banned, banned`. Terms are unique in the order they first come; the last list of banned renderings that
    isn't empty holds. A line of banned renderings without a term is an error."""
    bare = F.regexp_replace("line", "#.*$", "")
    term = strip(F.regexp_extract(bare, r"^([^|]*)", 1))
    banned = F.filter(F.transform(F.split(F.regexp_extract(bare, r"^[^|]*\|(.*)$", 1), "[,，、]"), lambda x: strip(x)), lambda x: x != "")
    rows = lines.select("line_no", term.alias("term"), banned.alias("banned"))
    rows = rows.withColumn("term", F.when((F.col("term") == "") & (F.size("banned") > 0), F.raise_error(F.concat(F.lit("banned renderings without a term in line "), F.col("line_no").cast("string")))).otherwise(F.col("term")))
    known = rows.where("term <> ''").groupBy("term").agg(F.min("line_no").alias("first"), F.max_by("banned", F.when(F.size("banned") > 0, F.col("line_no"))).alias("banned"))
    # a glossary is a short file: numbering it in one task is no matter of scale
    known = known.withColumn("ord", F.row_number().over(Window.orderBy("first")) - 1)
    return known.select("ord", "term", F.concat(F.lit("{v"), (F.col("ord") + 1_000_000).cast("string"), F.lit("}")).alias("token"), F.coalesce("banned", F.array().cast("array<string>")).alias("banned"), ((F.col("term") == F.upper("term")) & (F.col("term") != F.lower("term"))).alias("is_acronym"))
