"""Checks of a revised text against its source, as one struct column: ok and the first rule that fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import tokens
from docweave.functions.terms import Term, term_counts
from docweave.functions.text import is_prose, nfkc, strip_tags

#: Fixed values.
SCRIPTS = {"zh-TW": r"[\x{4e00}-\x{9fff}]", "zh-CN": r"[\x{4e00}-\x{9fff}]", "ja": r"[\x{3040}-\x{30ff}]", "ko": r"[\x{ac00}-\x{d7af}]"}
FUNCTION_WORDS = "is|are|was|were|have|has|we|this|these|those|reflects|show|shows|shown|can"


def untranslated(source: Column, output: Column, target: Column) -> Column:
    """The letters and digits are the source's, the target's script is missing, or Chinese keeps five characters of kana or Hangul."""
    plain = lambda c: F.regexp_replace(F.lower(nfkc(c)), r"(?U)[\W_]", "")
    lacks = F.lit(False)
    for code, script in SCRIPTS.items():
        lacks = lacks | ((target == code) & ~output.rlike(script))
    foreign = F.regexp_count(output, F.lit(r"[\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]")) >= 5
    return (plain(output) == plain(source)) | lacks | (target.startswith("zh") & foreign)


def guard(source: Column, revised: Column, source_lang: Column, target_lang: Column, terms: list[Term]) -> Column:
    """struct(ok, reason). Of several terms that fail, the one that comes first in the glossary is named."""
    want, have = tokens.multiset(source), tokens.multiset(revised)
    extra = tokens.minus(have, want)
    extra = F.when(source_lang == "en", tokens.minus(extra, tokens.number_words(source))).otherwise(extra)
    reason = F.when((F.size(tokens.minus(want, have)) > 0) | (F.size(extra) > 0), F.lit("numbers, tags or placeholders differ"))
    plain_source, plain_revised = strip_tags(source), strip_tags(revised)
    if terms:
        expected, found = term_counts(plain_source, terms), term_counts(plain_revised, terms)
        n = lambda m, t: F.coalesce(m[t.text], F.lit(0))
        for t in terms:
            reason = reason.when(n(expected, t) != n(found, t), F.concat(F.lit(f"term {t.text}: expected "), n(expected, t).cast("string"), F.lit(", found "), n(found, t).cast("string")))
        for t in terms:
            kept = F.lit(False)
            for b in t.banned:
                kept = kept | F.contains(revised, F.lit(b))
            reason = reason.when((n(expected, t) > 0) & kept, F.lit(f"rejected rendering of {t.text}"))
    usual = (source_lang == "en") & (target_lang == "zh-TW")
    english = plain_source.rlike(rf"(?iU)\b({FUNCTION_WORDS})\b") & ~revised.rlike(SCRIPTS["zh-TW"])
    reason = reason.when(usual & english, F.lit("prose became English"))
    reason = reason.when(~usual & is_prose(plain_source) & untranslated(plain_source, plain_revised, target_lang), F.lit("left untranslated"))
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def status(result: Column) -> Column:
    return F.when(result["ok"], F.lit("passed")).otherwise(F.concat(F.lit("failed: "), result["reason"]))
