"""What the text columns of a table look like: one fused pass over all of them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import parse, text
from millrace.operators.longform import SLOT, field as schema_field, melt, non_null
from millrace.operators.names import bare
from millrace.plans.config import CleanerConfig


FILLED = "_row_is_filled"


def delimiter_pattern(cfg: CleanerConfig) -> str:
    return "|".join(re.escape(d) for d in cfg.split_delimiters)


@dataclass
class Look:
    """Counts of one column.  ``n`` is the number of non-null values after text cleaning."""

    rows: int = 0  # rows that are not empty altogether
    present: int = 0  # non-null values before text cleaning
    same_hash: bool = False
    n: int = 0
    counts: dict[str, int] = field(default_factory=dict)

    def share(self, name: str) -> float:
        return (self.counts.get(name) or 0) / self.n if self.n else 0.0

    def null_share(self) -> float:
        return 1.0 - self.present / self.rows if self.rows else 0.0


def tidy(cfg: CleanerConfig, col: Column) -> Column:
    """The text without surplus characters.  ``null_marks`` follows as a step of its own, so that
    the regex passes run once per value although their result is tested and returned."""
    return text.tidy_text(
        col, invisible=cfg.remove_invisible_chars, collapse=cfg.collapse_internal_whitespace
    )


def null_marks(cfg: CleanerConfig, col: Column) -> Column:
    out = text.null_if_placeholder(col)
    return text.keep_ascii(out) if cfg.remove_non_ascii else out


def _type_counts(cfg: CleanerConfig, v: Column, some: Column, day: Column) -> dict[str, Column]:
    """``some`` is the value where it has a digit: all numeric readings need one."""
    out: dict[str, Column] = {}
    if cfg.coerce_numeric:
        out["number_look"] = F.count_if(parse.digits_only(some))
        out["number"] = F.count(parse.to_number(some))
    if cfg.coerce_datetime:
        out["time_look"] = F.count_if(parse.has_date_mark(v))
        for i, fmt in enumerate(parse.TIME_FORMATS):
            out[f"time_{i}"] = F.count(fmt.read(day))
        if cfg.mixed_dates:
            out["time_any"] = F.count(parse.to_time_mixed(day))
    if cfg.parse_percentages:
        out["percent_look"] = F.count_if(v.contains("%"))
        out["percent"] = F.count(parse.to_fraction(some))
    if cfg.parse_currency:
        out["amount_look"] = F.count_if(parse.has_currency(v, cfg.currency_symbols))
        out["amount"] = F.count(parse.to_amount(some, cfg.currency_symbols))
    if cfg.normalize_booleans:
        out["bool_look"] = F.count_if(parse.bool_like(v, cfg.true_set, cfg.false_set))
    if cfg.parse_json_columns:
        wrapped = text.looks_like_json(v)
        out["json_look"] = F.count_if(wrapped)
        out["json"] = F.count(F.try_parse_json(F.when(wrapped, v)))
    return out


def _shape_counts(cfg: CleanerConfig, v: Column, some: Column) -> dict[str, Column]:
    divided = text.contains_any(v, cfg.split_delimiters)
    pattern, limit = delimiter_pattern(cfg), cfg.max_splits_per_col + 1
    return {
        "compound_look": F.count_if(divided),
        "parts": F.max(F.size(F.split(F.when(divided, v), pattern, limit))),
        "length": F.sum(F.length(v)),
        "digit_look": F.count(some),
    }


def _with_digit(melted: DataFrame) -> DataFrame:
    return melted.withColumn("some", F.when(parse.has_digit(F.col("v")), F.col("v")))


def _collect(melted: DataFrame, cfg: CleanerConfig, aggs: dict[str, Column]) -> dict[int, T.Row]:
    rows = melted.groupBy(SLOT).agg(*(c.alias(k) for k, c in aggs.items())).collect()
    return {r[SLOT]: r for r in rows}


def comparable(df: DataFrame, name: str) -> Column:
    dtype, col = schema_field(df, name).dataType, non_null(df, name)
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return F.to_json(col)
    return col


def look_at_table(df: DataFrame, cfg: CleanerConfig) -> tuple[int, dict[str, Look]]:
    """Null shares, constancy and all text looks of every column in one scan.

    Returns the number of input rows too.  Non-text columns only take part in the former two.
    """
    columns = df.columns
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    if not columns:
        return 0, {}
    # One flag per row, not one per row and column.
    values = [F.when(non_null(df, c).isNotNull(), F.lit(True)) for c in columns]
    df = df.withColumn(FILLED, F.coalesce(*values, F.lit(False)))
    parts = []
    for c in columns:
        col = non_null(df, c)
        parts.append(
            {
                "filled": F.col(FILLED),
                "present": col.isNotNull(),
                "h": F.when(col.isNotNull(), F.xxhash64(comparable(df, c))),
                "v": tidy(cfg, col) if c in strings else F.lit(None).cast("string"),
            }
        )
    melted = melt(df, parts).withColumn("v", null_marks(cfg, F.col("v")))
    melted = _with_digit(melted).withColumn("day", parse.date_candidate(F.col("some")))
    v, some = F.col("v"), F.col("some")
    aggs = {
        "all_rows": F.count(F.lit(1)),
        "rows": F.count_if("filled"),
        "present": F.count_if("present"),
        "h_min": F.min("h"),
        "h_max": F.max("h"),
        "n": F.count("v"),
    }
    if strings:
        aggs |= _type_counts(cfg, v, some, F.col("day")) | _shape_counts(cfg, v, some)
    found = _collect(melted, cfg, aggs)
    looks, total = {}, 0
    for i, c in enumerate(columns):
        r = found.get(i)
        if r is None:  # no input rows at all
            looks[c] = Look()
            continue
        total = r["all_rows"]
        looks[c] = Look(
            r["rows"], r["present"], r["h_min"] == r["h_max"], r["n"], r.asDict()
        )
    return total, looks


def look_at_shapes(
    df: DataFrame, columns: Sequence[str], cfg: CleanerConfig, n_rows: int
) -> dict[str, Look]:
    """Delimiter, part and digit counts of columns that only came into being on the way.

    ``n_rows`` is the number of rows with any value; ``df`` may hold others.
    """
    if not columns:
        return {}
    melted = _with_digit(melt(df, [{"v": bare(c)} for c in columns]))
    aggs = {"n": F.count("v")}
    aggs |= _shape_counts(cfg, F.col("v"), F.col("some"))
    found = _collect(melted, cfg, aggs)
    out = {}
    for i, c in enumerate(columns):
        r = found.get(i)
        out[c] = Look(n_rows, r["n"], False, r["n"], r.asDict()) if r else Look()
    return out


@dataclass
class Reading:
    """How a text column is read as a typed one."""

    kind: str  # number, time, percent, amount, bool
    pattern: str | None = None

    def apply(self, cfg: CleanerConfig, col: Column) -> Column:
        if self.kind == "number":
            return parse.to_number(col)
        if self.kind == "time":
            if cfg.mixed_dates:
                return parse.to_time_mixed(col, self.pattern)
            return parse.to_time(col, self.pattern)
        if self.kind == "percent":
            return parse.to_fraction(col)
        if self.kind == "amount":
            return parse.to_amount(col, cfg.currency_symbols)
        return parse.to_bool(col, cfg.true_set, cfg.false_set, strip=False)


def choose_reading(cfg: CleanerConfig, look: Look) -> Reading | None:
    """The first kind, in step order, that the column looks like and that really parses."""
    if not look.n:
        return None

    def fits(kind: str, share: float, parsed: str | None = None) -> bool:
        return (
            look.share(f"{kind}_look") > share
            and look.share(parsed or kind) >= cfg.min_parse_ratio
        )

    if cfg.coerce_numeric and fits("number", cfg.numeric_share):
        return Reading("number")
    if cfg.coerce_datetime:
        hits = [look.counts.get(f"time_{i}") or 0 for i in range(len(parse.TIME_FORMATS))]
        best = max(range(len(hits)), key=lambda i: (hits[i], -i))
        if fits("time", cfg.datetime_share, "time_any" if cfg.mixed_dates else f"time_{best}"):
            return Reading("time", parse.TIME_FORMATS[best].pattern)
    if cfg.parse_percentages and fits("percent", cfg.percent_share):
        return Reading("percent")
    if cfg.parse_currency and fits("amount", cfg.currency_share):
        return Reading("amount")
    if cfg.normalize_booleans and fits("bool", cfg.boolean_share, "bool_look"):
        return Reading("bool")
    return None


def is_json(cfg: CleanerConfig, look: Look) -> bool:
    return (
        cfg.parse_json_columns
        and look.share("json_look") > cfg.json_share
        and look.share("json") >= cfg.min_parse_ratio
    )


def part_count(cfg: CleanerConfig, look: Look) -> int:
    """Number of part columns a compound column is split into, 0 if it stays."""
    if look.share("compound_look") <= cfg.compound_share:
        return 0
    limit = cfg.split_max_avg_len
    if limit is not None and (look.counts.get("length") or 0) / look.n > limit:
        return 0
    return look.counts.get("parts") or 0


def holds_numbers(cfg: CleanerConfig, look: Look) -> bool:
    """More than half of all rows, empty values included, contain a digit."""
    return bool(look.rows) and (look.counts["digit_look"] or 0) / look.rows > cfg.digit_share
