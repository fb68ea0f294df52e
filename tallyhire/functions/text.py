"""Text rules: trimming, falsy values, search patterns, limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = r"[\s ﻿\p{Z}]+"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends; Spark's trim takes spaces only."""
    return F.regexp_replace(c, rf"^{BLANKS}|{BLANKS}$", "")


def is_falsy(c: Column, numeric: bool = False) -> Column:
    """Missing as JavaScript sees it: null, '' and, for numbers, 0."""
    return F.coalesce(c == (0 if numeric else ""), F.lit(True))


def or_else(c: Column, other: Column) -> Column:
    """c, or other where c is null or ''."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def contains_pattern(term: Column) -> Column:
    r"""%term% for ilike. % and _ in the term stay wildcards; a backslash escapes only what must be escaped.

    A database takes `\c` for an ordinary c as that c, where Spark raises an error, so such backslashes go. A term that
    ends in an odd backslash makes the last % literal.
    """
    mark = "\u0001"
    out = F.regexp_replace(F.concat(F.lit("%"), term, F.lit("%")), r"(?s)\\(.)", f"{mark}$1")
    for escaped in ("\\", "%", "_"):
        out = F.replace(out, F.lit(mark + escaped), F.lit("\\\u0002" if escaped == "\\" else "\\" + escaped))
    return F.replace(F.replace(out, F.lit(mark)), F.lit("\u0002"), F.lit("\\"))


def contains_ilike(c: Column, term: Column) -> Column:
    """Case-insensitive containment of a typed term; null where c is null."""
    return F.call_function("ilike", c, contains_pattern(term))


def fits(c: Column, limit: int) -> Column:
    """At most so many characters; null fits."""
    return F.coalesce(F.length(c) <= limit, F.lit(True))


def decimal_or_null(c: Column, precision: int, scale: int) -> Column:
    """Rounded to scale; null where it has too many digits."""
    return c.try_cast(T.DecimalType(precision, scale))


def comma_list(c: Column) -> Column:
    """A sorted, comma-joined array of strings."""
    return F.array_join(F.sort_array(c), ",")
