"""Row-level operators: empty rows, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.names import bare


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is NULL (or NaN)."""
    return df.na.drop("all")


def dedupe_rows(
    df: DataFrame, keys: Sequence[str] | None = None, order: Sequence[str | Column] = ()
) -> DataFrame:
    """One row per group of equal rows, or per key.

    Both forms are aggregates that are combined map-side, so a group of copies of any size reaches
    the shuffle as one row per task.  With keys the row kept is the first by ``order`` and then by
    all other columns, which makes the choice independent of partitioning.
    """
    if not keys:
        return df.dropDuplicates()
    lead = [bare(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(
        *(o.alias(f"_o{i}") for i, o in enumerate(lead)),
        F.struct(*(bare(c) for c in rest)).alias("_row"),
    )
    first = df.groupBy(*(bare(k) for k in keys)).agg(F.min(ranked).alias("_first"))
    kept = {c: F.col("_first._row").getField(c) for c in rest}
    return first.select(*((bare(c) if c in keys else kept[c]).alias(c) for c in df.columns))
