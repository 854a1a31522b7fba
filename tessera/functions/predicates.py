"""Predicates of the dialect as Column builders; all stay inside whole-stage codegen or built-ins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: str | Column) -> Column:
    """Lower-case words of letters a-z and digits, in order."""
    return F.filter(F.split(F.lower(_column(c)), "[^a-z0-9]+"), lambda x: x != "")


def word_pattern(word: str) -> str | None:
    """A pattern that finds a word of letters a-z and digits as one of ``tokens``; None for anything else."""
    low = word.lower()
    return f"(?<![a-z0-9]){low}(?![a-z0-9])" if re.fullmatch("[a-z0-9]+", low) else None


def contains_word(c: str | Column, word: str) -> Column:
    """Whole-word membership, case-insensitive; a phrase never matches.

    A plain word is searched for between boundaries, without cutting the text into its words.
    """
    if pattern := word_pattern(word):
        return F.lower(_column(c)).rlike(pattern)
    return F.array_contains(F.split(F.lower(_column(c)), "[^a-z0-9]+"), word.lower())


def array_has(c: str | Column, value: object) -> Column:
    return F.array_contains(_column(c), value)


def json_text(c: str | Column, key: str) -> Column:
    """Text of a top-level key of a JSON string; null where it is missing or the text is no JSON."""
    path = "$['" + key.replace("'", "\\'") + "']"
    return F.try_variant_get(F.try_parse_json(_column(c)), path, "string")


def overlaps(start: str | Column, end: str | Column, low: object, high: object) -> Column:
    """Intervals [start, end] and [low, high] share a point; both ends belong to them."""
    return (_column(start) <= high) & (_column(end) >= low)


def like(c: str | Column, pattern: str) -> Column:
    """``%`` and ``_`` are wild; a backslash is an ordinary character."""
    return _column(c).like(pattern.replace("\\", "\\\\"))


def compare(c: str | Column, op: str, other: object) -> Column:
    """One of the dialect's six comparisons, with SQL's three-valued logic."""
    left, right = _column(c), other if isinstance(other, Column) else F.lit(other)
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
