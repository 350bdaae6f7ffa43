"""Multisets of the tokens that a revision must keep, as maps from token to count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import bound

KEPT = r"(?U)(\{v\d+\}|</?style(?:\s[^>]+)?>|\d+(?:[.,]\d+)?)"
#: English number words by the digits that other languages write.
NUMBER_WORDS = {
    "1": ("one", "first"),
    "2": ("two", "second"),
    "3": ("three", "third"),
    "4": ("four", "fourth"),
    "5": ("five", "fifth"),
    "6": ("six", "sixth"),
    "7": ("seven", "seventh"),
    "8": ("eight", "eighth"),
    "9": ("nine", "ninth"),
    "10": ("ten", "tenth"),
}


def multiset(c: Column, pattern: str = KEPT) -> Column:
    return multiset_of(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))


def multiset_of(found: Column) -> Column:
    """A map from each element of an array to its count. Elements are sorted and their runs counted, so very many cost no more
    than the sort."""

    def counted(found: Column) -> Column:
        starts = F.filter(F.transform(found, lambda x, i: i), lambda i: (i == 0) | (F.get(found, i) != F.get(found, i - 1)))
        return bound(starts, lambda s: F.map_from_entries(F.transform(s, lambda a, k: F.struct(F.get(found, a), F.coalesce(F.get(s, k + 1), F.size(found)) - a))))

    return bound(F.array_sort(found), counted)


def minus(a: Column, b: Column) -> Column:
    """What a has more of than b; nothing below zero."""
    return F.map_filter(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))), lambda k, v: v > 0)


def number_words(c: Column) -> Column:
    """How often each digit is there as a number word; several words of one digit add up."""
    counts = [F.regexp_count(c, F.lit(rf"(?iU)\b(?:{'|'.join(words)})\b")) for words in NUMBER_WORDS.values()]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, NUMBER_WORDS)), F.array(*counts)), lambda k, v: v > 0)
