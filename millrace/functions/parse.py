"""Typed readings of text columns.  Unreadable text becomes NULL, never an error."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import contains_any, strip_space

# Fixed values.
TRUE_TEXTS = ("true", "yes", "y", "1", "t")
FALSE_TEXTS = ("false", "no", "n", "0", "f")
CURRENCY_SYMBOLS = "$€£₹"

# Spark's own cast accepts "5d" and "inf"; only texts of these characters are handed to it.
# Commas are thousands separators and may stand anywhere.
_NUMBER = r"^[-+.,\d\seE]+$"
_PERCENT = r"^\s*[+-]?(?:\d+[.,]?\d*|[.,]\d+)(?:[eE][+-]?\d+)?\s*%?\s*$"
_DIGITS_ONLY = r"^[.,]*-?[.,]*\d[\d.,]*$"
_FIRST_NUMBER = r"([-+]?\d*\.?\d+)"


def digits_only(col: Column) -> Column:
    """True where only an optional sign and digits remain after dropping ``,`` and ``.``."""
    return col.rlike(_DIGITS_ONLY)


def to_number(col: Column) -> Column:
    """``"1,234.5"`` → 1234.5."""
    return F.when(col.rlike(_NUMBER), F.replace(col, F.lit(","), F.lit("")).try_cast("double"))


def to_fraction(col: Column) -> Column:
    """``"12.5%"`` and ``"12,5%"`` → 0.125."""
    plain = F.translate(col, ",%", ".")
    return F.when(col.rlike(_PERCENT), plain.try_cast("double") / F.lit(100.0))


def has_currency(col: Column, symbols: str = CURRENCY_SYMBOLS) -> Column:
    return contains_any(col, symbols)


def to_amount(col: Column, symbols: str = CURRENCY_SYMBOLS) -> Column:
    """``"$1,234.50"`` → 1234.5; symbols may stand anywhere."""
    shape = rf"^[-+.,\d\seE{re.escape(symbols)}]+$"
    return F.when(col.rlike(shape), F.translate(col, symbols + ",", "").try_cast("double"))


def bool_like(
    col: Column, true: Iterable[str] = TRUE_TEXTS, false: Iterable[str] = FALSE_TEXTS
) -> Column:
    return F.lower(col).isin(*true, *false)


def to_bool(
    col: Column,
    true: Iterable[str] = TRUE_TEXTS,
    false: Iterable[str] = FALSE_TEXTS,
    strip: bool = True,
) -> Column:
    word = F.lower(strip_space(col)) if strip else F.lower(col)
    return F.when(word.isin(*true), F.lit(True)).when(word.isin(*false), F.lit(False))


def first_number(col: Column) -> Column:
    """The first signed decimal inside a text."""
    return F.nullif(F.regexp_extract(col, _FIRST_NUMBER, 1), F.lit("")).try_cast("double")


def has_digit(col: Column) -> Column:
    return col.rlike(r"\d")


@dataclass(frozen=True)
class TimeFormat:
    """A timestamp pattern and the shape a text must have before it is tried.

    The shape test keeps the (slow, exception-driven) parser away from ordinary text.
    """

    pattern: str
    shape: str

    def read(self, col: Column) -> Column:
        return F.when(col.rlike(f"^{self.shape}$"), F.try_to_timestamp(col, F.lit(self.pattern)))


_CLOCK = r"\d{2}:\d{2}:\d{2}"
_YMD = r"\d{4}-\d{1,2}-\d{1,2}"
_MON = "[A-Za-z]{3}"

# Earlier entries win ties, so 03/04/2024 is read month first.
TIME_FORMATS = (
    TimeFormat("yyyy-M-d", _YMD),
    TimeFormat("yyyy-M-d HH:mm:ss", f"{_YMD} {_CLOCK}"),
    TimeFormat("yyyy-M-d HH:mm", rf"{_YMD} \d{{2}}:\d{{2}}"),
    TimeFormat("yyyy-M-d HH:mm:ss[.SSSSSS][.SSS]", rf"{_YMD} {_CLOCK}\.(?:\d{{3}}|\d{{6}})"),
    TimeFormat("yyyy-M-d'T'HH:mm:ss", f"{_YMD}T{_CLOCK}"),
    TimeFormat("yyyy-M-d'T'HH:mm:ss[.SSSSSS][.SSS]", rf"{_YMD}T{_CLOCK}\.(?:\d{{3}}|\d{{6}})"),
    TimeFormat("yyyy-M-d'T'HH:mm:ssXXX", rf"{_YMD}T{_CLOCK}(?:Z|[+-]\d{{2}}:\d{{2}})"),
    TimeFormat("yyyy/M/d", r"\d{4}/\d{1,2}/\d{1,2}"),
    TimeFormat("yyyy/M/d HH:mm:ss", rf"\d{{4}}/\d{{1,2}}/\d{{1,2}} {_CLOCK}"),
    TimeFormat("yyyy.M.d", r"\d{4}\.\d{1,2}\.\d{1,2}"),
    TimeFormat("M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"),
    TimeFormat("M/d/yyyy H:mm", r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}"),
    TimeFormat("M/d/yyyy HH:mm:ss", rf"\d{{1,2}}/\d{{1,2}}/\d{{4}} {_CLOCK}"),
    TimeFormat("d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"),
    TimeFormat("M-d-yyyy", r"\d{1,2}-\d{1,2}-\d{4}"),
    TimeFormat("d-M-yyyy", r"\d{1,2}-\d{1,2}-\d{4}"),
    TimeFormat("d.M.yyyy", r"\d{1,2}\.\d{1,2}\.\d{4}"),
    TimeFormat("d-MMM-yyyy", rf"\d{{1,2}}-{_MON}-\d{{4}}"),
)

_DATE_START = rf"^\d{{1,4}}[-/.](?:\d{{1,2}}|{_MON})[-/.]\d"


def date_candidate(col: Column) -> Column:
    """The text itself where it starts like a date, else NULL: one cheap test for all formats."""
    return F.when(col.rlike(_DATE_START), col)


def has_date_mark(col: Column) -> Column:
    return contains_any(col, "-/:.")


def format_named(pattern: str) -> TimeFormat:
    for known in TIME_FORMATS:
        if known.pattern == pattern:
            return known
    raise ValueError(f"unknown timestamp pattern: {pattern}")


def to_time(col: Column, pattern: str) -> Column:
    """Read with one format, as fitted for the whole column."""
    return format_named(pattern).read(col)


def to_time_mixed(col: Column, first: str | None = None) -> Column:
    """Read with every known format, the fitted one first."""
    order = sorted(TIME_FORMATS, key=lambda f: f.pattern != first)
    return F.coalesce(*(f.read(col) for f in order))
