"""Value frequencies of many columns, the base of distinct counts, top values and modes.

Columns are melted per physical type (long, double, text), so numbers are never turned into text
before they are counted.  Counting is combined map-side: a value that fills a third of the rows
reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.longform import SLOT, field, melt, named, non_null
from millrace.operators.names import bare
from millrace.session import scratch_path

_LONGS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampType, T.TimestampNTZType)


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, (*_LONGS, T.BooleanType, T.DateType, *_TIMES)):
        return "long"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return "text"


def key_of(df: DataFrame, name: str) -> Column:
    """The value in its family's type."""
    dtype, col = field(df, name).dataType, non_null(df, name)
    if isinstance(dtype, _TIMES):
        return F.unix_micros(col.cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("long")
    family = _family(dtype)
    if family == "text":
        simple = isinstance(dtype, (T.StringType, T.DecimalType))
        return col.cast("string") if simple else F.to_json(F.struct(col.alias("v")))
    return col.cast(family)


def _shown(dtype: T.DataType, key: Column) -> Column:
    """A key back as readable text."""
    if isinstance(dtype, _TIMES):
        return F.timestamp_micros(key).cast("string")
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(key.cast("int")).cast("string")
    if isinstance(dtype, T.BooleanType):
        return (key == 1).cast("string")
    return key.cast("string")


def value_counts(df: DataFrame, columns: Sequence[str]) -> list[tuple[list[str], DataFrame]]:
    """Per type family: its columns and a frame ``(slot, value, n)`` over the non-null values."""
    families: dict[str, list[str]] = {}
    for c in columns:
        families.setdefault(_family(field(df, c).dataType), []).append(c)
    out = []
    for names in families.values():
        if len(names) == 1:  # nothing to melt: keep the column's own vectorised scan
            keyed = df.select(F.lit(0).alias(SLOT), key_of(df, names[0]).alias("value"))
        else:
            keyed = melt(df, [{"value": key_of(df, c)} for c in names])
        counted = keyed.where(F.col("value").isNotNull()).groupBy(SLOT, "value")
        out.append((names, counted.agg(F.count(F.lit(1)).alias("n"))))
    return out


Counts = list[tuple[list[str], DataFrame]]


def pinned_counts(df: DataFrame, columns: Sequence[str]) -> Counts:
    """The value counts stored once below the shared folder, for several uses."""
    spark, out = df.sparkSession, []
    for names, counts in value_counts(df, columns):
        path = scratch_path(spark, "value-counts")
        counts.write.parquet(path)
        out.append((names, spark.read.schema(counts.schema).parquet(path)))
    return out


def _counted(df: DataFrame, columns: Sequence[str], counts: Counts | None) -> Counts:
    """The given counts cut down to ``columns``, or counts of their own."""
    if counts is None:
        return value_counts(df, columns)
    wanted = set(columns)
    kept = [(names, [i for i, c in enumerate(names) if c in wanted], frame) for names, frame in counts]
    return [
        (names, frame if len(slots) == len(names) else frame.where(F.col(SLOT).isin(*slots)))
        for names, slots, frame in kept
        if slots
    ]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def distinct_counts(
    df: DataFrame, columns: Sequence[str], approx: bool = False, counts: Counts | None = None
) -> DataFrame:
    """``(column_name, n_distinct)`` over non-null values.

    Exact counting shuffles each column's distinct values; ``approx`` needs one small sketch
    per column instead.
    """
    if approx:
        frames = [
            melt(df, [{"value": key_of(df, c)} for c in names])
            .groupBy(SLOT)
            .agg(F.approx_count_distinct("value", 0.01).alias("n_distinct"))
            .transform(named, names)
            for names in by_family(df, columns)
        ]
        return _union(frames)
    return _union(
        [
            named(found.groupBy(SLOT).agg(F.count(F.lit(1)).alias("n_distinct")), names)
            for names, found in _counted(df, columns, counts)
        ]
    )


def by_family(df: DataFrame, columns: Sequence[str]) -> list[list[str]]:
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(_family(field(df, c).dataType), []).append(c)
    return list(out.values())


def top_values(
    df: DataFrame, columns: Sequence[str], k: int = 5, counts: Counts | None = None
) -> DataFrame:
    """``(column_name, value, n, rank)``: the k most frequent non-null values per column.

    Ties go to the smaller value.  Spark limits each task's candidates to k per column before
    the shuffle, so no task sorts a whole column.
    """
    order = Window.partitionBy(SLOT).orderBy(F.desc("n"), F.asc("value"))
    frames = []
    for names, found in _counted(df, columns, counts):
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        shown = shown_by_slot(df, names, F.col("value")).alias("value")
        frames.append(named(best.select(SLOT, shown, "n", F.col("rank").cast("long")), names))
    return _union(frames)


def shown_by_slot(df: DataFrame, names: Sequence[str], key: Column) -> Column:
    kinds: dict[T.DataType, list[int]] = {}
    for i, c in enumerate(names):
        kinds.setdefault(field(df, c).dataType, []).append(i)
    if len(kinds) == 1:
        return _shown(next(iter(kinds)), key)
    cases = F
    for kind, slots in kinds.items():
        cases = cases.when(F.col(SLOT).isin(*slots), _shown(kind, key))
    return cases


def value_summary(
    df: DataFrame, columns: Sequence[str], counts: Counts | None = None
) -> DataFrame:
    """``(column_name, count, unique, top, freq)`` from one table of value counts per type family.

    Columns without any value have a row too.
    """
    frames = [df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")]
    for names, own in _counted(df, columns, counts):
        best = F.min(F.struct((-F.col("n")).alias("minus"), F.col("value"))).alias("best")
        found = own.groupBy(SLOT).agg(
            F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best
        )
        top = shown_by_slot(df, names, F.col("best.value")).alias("top")
        frames.append(
            named(found.select(SLOT, "count", "unique", top, (-F.col("best.minus")).alias("freq")), names)
        )
    out = frames[0].join(_union(frames[1:]), "column_name", "left")
    none = F.lit(0)
    return out.withColumns(
        {"count": F.coalesce("count", none), "unique": F.coalesce("unique", none)}
    )


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent text per column, the smallest on ties; all-null columns are left out."""
    if not columns:
        return {}
    rows = top_values(df, columns, 1).select("column_name", "value").collect()
    return {c: v for c, v in rows}


def duplicate_count(df: DataFrame) -> DataFrame:
    """``(duplicate_rows)``: rows beyond the first of each group of equal rows."""
    groups = df.groupBy(*(bare(c) for c in df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
