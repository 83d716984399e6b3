"""Text helpers as plain Catalyst expressions; NULL stays NULL in all of them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no value" (exact, case-sensitive).
NULL_TEXTS = ("", "na", "n/a", "null", "nan", "-", "--", "none", "Nil", "NIL", "NULL", "NaN")

# Unicode white space plus the four separator controls that Python also counts as space.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_INVISIBLE = r"[\u200B-\u200D\uFEFF]"
_INVISIBLE_CHARS = ("\u200b", "\u200c", "\u200d", "\ufeff")


def strip_space(col: Column) -> Column:
    """Remove white space at both ends (``trim`` alone would only remove blanks)."""
    return F.regexp_replace(col, _EDGE_SPACE, "")


def contains_any(col: Column, parts: Iterable[str]) -> Column:
    """True where one of the literal texts occurs.

    Byte searches need no decoding of the value, which is most of what a regex test costs.
    """
    tests = [col.contains(p) for p in parts]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def drop_invisible(col: Column) -> Column:
    """Remove zero-width characters and byte-order marks, where there are any."""
    found = contains_any(col, _INVISIBLE_CHARS)
    return F.when(found, F.regexp_replace(col, _INVISIBLE, "")).otherwise(col)


def collapse_space(col: Column) -> Column:
    """Turn every run of white space into one blank and strip the ends."""
    return F.trim(F.regexp_replace(col, _SPACE, " "))


def null_if_placeholder(col: Column, placeholders: Iterable[str] = NULL_TEXTS) -> Column:
    """NULL for texts that only stand for a missing value."""
    return F.when(~col.isin(*placeholders), col)


def keep_ascii(col: Column) -> Column:
    return F.regexp_replace(col, r"[^\x00-\x7F]", "")


def set_case(col: Column, mode: str) -> Column:
    if mode == "lower":
        return F.lower(col)
    if mode == "upper":
        return F.upper(col)
    return col


def looks_like_json(col: Column) -> Column:
    """True where the trimmed text is wrapped in matching braces or brackets."""
    t = F.trim(col)
    braces = t.startswith("{") & t.endswith("}")
    brackets = t.startswith("[") & t.endswith("]")
    return braces | brackets


def tidy_text(col: Column, *, invisible: bool = True, collapse: bool = True) -> Column:
    """Strip, drop invisible characters and collapse in as few regex passes as possible.

    Collapsing also strips, so the separate strip is only needed without it.
    """
    out = col if collapse else strip_space(col)
    if invisible:
        out = drop_invisible(out)
    return collapse_space(out) if collapse else out
