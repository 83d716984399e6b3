"""Profiles of a table as long-form frames, one row per column (or column pair, or value)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import frequency
from millrace.operators.longform import (
    SLOT,
    as_double,
    field,
    melt,
    melt_numbers,
    named,
    non_null,
    number_columns,
    text_columns,
)
from millrace.operators.moments import moments
from millrace.operators.quantiles import approx_quantiles, exact_quantiles

Z_LIMIT = 3.0  # fixed value: |z| above it is an outlier
HIGH_NULL = 0.3  # fixed value: share of NULLs above which a column is reported
HIGH_DISTINCT = 0.7  # fixed value: distinct values per row above which a column is reported

PAIRS_PER_JOB = 300  # more pairs are summed as matrices
MATRIX_ROWS = 4096

_WIDTHS = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
}


def _checked(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    chosen = list(columns) if columns is not None else df.columns
    missing = [c for c in chosen if c not in df.columns]
    if missing:
        raise ValueError(f"Column '{missing[0]}' not found in dataset.")
    return chosen


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def null_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, type, n_rows, n_null)``."""
    chosen = _checked(df, columns)
    counted = (
        melt(df, [{"there": non_null(df, c).isNotNull()} for c in chosen])
        .groupBy(SLOT)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(~F.col("there")).alias("n_null"),
        )
    )
    types = F.array(*(F.lit(field(df, c).dataType.simpleString()) for c in chosen))
    typed = counted.select(SLOT, F.get(types, F.col(SLOT)).alias("type"), "n_rows", "n_null")
    return named(typed, chosen)


def high_null_columns(df: DataFrame, limit: float = HIGH_NULL) -> DataFrame:
    """``(column_name, null_ratio)`` of columns with more than ``limit`` NULLs."""
    ratio = F.try_divide(F.col("n_null"), F.col("n_rows"))
    return null_summary(df).select("column_name", ratio.alias("null_ratio")).where(
        F.col("null_ratio") > limit
    )


def high_cardinality_columns(
    df: DataFrame,
    limit: float = HIGH_DISTINCT,
    approx: bool = False,
    counts: frequency.Counts | None = None,
) -> DataFrame:
    """``(column_name, n_distinct, distinct_ratio)``: distinct values over **all** rows."""
    rows = null_summary(df).select("column_name", "n_rows")
    joined = frequency.distinct_counts(df, df.columns, approx, counts).join(rows, "column_name")
    ratio = F.try_divide(F.col("n_distinct"), F.col("n_rows"))
    return joined.select("column_name", "n_distinct", ratio.alias("distinct_ratio")).where(
        F.col("distinct_ratio") > limit
    )


def _summaries(df: DataFrame, columns: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Row and NULL counts of all columns and the moments of the numeric ones, in one pass."""
    none = F.lit(None).cast("double")
    parts = [
        {
            "there": non_null(df, c).isNotNull(),
            "x": as_double(df, c) if c in numbers else none,
        }
        for c in columns
    ]
    x = F.col("x")
    return (
        melt(df, parts)
        .groupBy(SLOT)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(~F.col("there")).alias("n_null"),
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_pop(x).alias("sd_pop"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        )
        # The sample deviation follows from the other; it is undefined for one value.
        .withColumn("std", F.col("sd_pop") * F.sqrt(F.try_divide(F.col("count"), F.col("count") - 1)))
    )


def number_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, count, mean, std, min, max)`` of the numeric columns; sample deviation."""
    chosen = number_columns(df, with_bool=True) if columns is None else _checked(df, columns)
    stats = _summaries(df, chosen, chosen).select(SLOT, "count", "mean", "std", "min", "max")
    return named(stats, chosen)


def outlier_counts(
    df: DataFrame, columns: Sequence[str] | None = None, limit: float = Z_LIMIT
) -> DataFrame:
    """``(column_name, outlier_count)``: values with ``|z| > limit``, population deviation.

    The first pass returns mean and deviation per column, the second counts.
    """
    chosen = number_columns(df) if columns is None else _checked(df, columns)
    found = moments(df, [as_double(df, c) for c in chosen], chosen)
    return _count_outliers(df, {c: (m.mean, m.sd) for c, m in found.items()}, limit)


def _count_outliers(df: DataFrame, found: dict[str, tuple], limit: float = Z_LIMIT) -> DataFrame:
    chosen = list(found)
    parts = []
    for c, (mean, sd) in found.items():
        z = F.abs((as_double(df, c) - F.lit(mean)) / F.lit(sd)) if sd else F.lit(0.0)
        parts.append({"far": z > limit})
    counted = melt(df, parts).groupBy(SLOT).agg(F.count_if("far").alias("outlier_count"))
    return named(counted, chosen)


def profile_columns(
    df: DataFrame, columns: Sequence[str] | None = None, approx_distinct: bool = False
) -> DataFrame:
    """One row per column: type, null and distinct percentages, numeric summary, outliers.

    Three passes: one fused summary (whose few numbers the outlier count needs), the distinct
    counts and the outlier count.  Only their one row per column is joined.
    """
    chosen = _checked(df, columns)
    numbers = [c for c in chosen if c in number_columns(df, with_bool=True)]
    spark = df.sparkSession
    rows = {r[SLOT]: r for r in _summaries(df, chosen, numbers).collect()}
    base = spark.createDataFrame(
        [
            (
                c,
                field(df, c).dataType.simpleString(),
                *(rows[i][k] for k in ("n_rows", "n_null", "mean", "std", "min", "max")),
            )
            for i, c in enumerate(chosen)
            if i in rows
        ],
        "column_name string, type string, n_rows bigint, n_null bigint, mean double, std double, "
        "min double, max double",
    )
    out = base.join(
        frequency.distinct_counts(df, chosen, approx_distinct), "column_name", "left"
    )
    found = {
        c: (rows[i]["mean"], rows[i]["sd_pop"])
        for i, c in enumerate(chosen)
        if c in numbers and i in rows
    }
    if found:
        out = out.join(_count_outliers(df, found), "column_name", "left")
    else:
        out = out.withColumn("outlier_count", F.lit(None).cast("bigint"))
    valid = F.col("n_rows") - F.col("n_null")
    return out.select(
        "column_name",
        F.col("type").alias("inferred_type"),
        F.round(_ratio(F.col("n_null"), F.col("n_rows")) * 100, 2).alias("null_percent"),
        F.round(_ratio(F.coalesce("n_distinct", F.lit(0)), valid) * 100, 2).alias(
            "unique_percent"
        ),
        "mean",
        "std",
        "min",
        "max",
        "outlier_count",
    )


def describe(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approx: bool = False,
    counts: frequency.Counts | None = None,
) -> DataFrame:
    """count, unique, top, freq for text; mean, std, min, quartiles, max for numbers."""
    chosen = _checked(df, columns)
    numbers = [c for c in chosen if c in number_columns(df)]
    others = [c for c in chosen if c not in numbers]
    none = lambda kind: F.lit(None).cast(kind)
    frames = []
    if numbers:
        find = approx_quantiles if approx else exact_quantiles
        quartiles = find(df, numbers, [0.25, 0.5, 0.75])
        table = F.create_map(
            *(
                x
                for c in numbers
                for x in (F.lit(c), F.array(*(F.lit(v).cast("double") for v in quartiles[c])))
            )
        )
        stats = number_summary(df, numbers).withColumn("q", table[F.col("column_name")])
        frames.append(
            stats.select(
                "column_name",
                "count",
                none("bigint").alias("unique"),
                none("string").alias("top"),
                none("bigint").alias("freq"),
                "mean",
                "std",
                "min",
                *(F.get("q", i).alias(f"p{p}") for i, p in enumerate((25, 50, 75))),
                "max",
            )
        )
    if others:
        frames.append(
            frequency.value_summary(df, others, counts).select(
                "column_name",
                "count",
                "unique",
                "top",
                "freq",
                *(
                    none("double").alias(n)
                    for n in ("mean", "std", "min", "p25", "p50", "p75", "max")
                ),
            )
        )
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(x, y, corr)`` for every ordered pair of numeric columns, over rows where both exist.

    Undefined values are 0 (plain ``corr`` raises on constant columns).  A first pass gives mean
    and deviation per column; the second sums products of the centred values.  A pair without
    NULLs needs one sum, others also the moments over their common rows.
    """
    chosen = number_columns(df) if columns is None else _checked(df, columns)
    spark = df.sparkSession
    stats = {
        r[SLOT]: r
        for r in melt_numbers(df, chosen)
        .groupBy(SLOT)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("x").alias("n"),
            F.avg("x").alias("mean"),
            F.stddev_pop("x").alias("sd"),
        )
        .collect()
    }
    settled: list[tuple[str, str, float]] = []
    open_pairs: list[tuple[int, int]] = []
    for i, x in enumerate(chosen):
        for j in range(i, len(chosen)):
            dead = any(k not in stats or not stats[k]["sd"] for k in (i, j))
            if dead or i == j:
                value = 0.0 if dead else 1.0
                settled += [(x, chosen[j], value)] + ([(chosen[j], x, value)] if i != j else [])
            else:
                open_pairs.append((i, j))
    if len(open_pairs) > PAIRS_PER_JOB:
        values = _matrix_correlations(df, chosen, stats, open_pairs)
    else:
        values = _pair_correlations(df, chosen, stats, open_pairs) if open_pairs else []
    for (i, j), value in zip(open_pairs, values):
        settled += [(chosen[i], chosen[j], value), (chosen[j], chosen[i], value)]
    return spark.createDataFrame(settled, "x string, y string, corr double")


def _matrix_correlations(df, chosen, stats, pairs) -> list[float]:
    """All pairs in one scan: each task adds up products of the centred columns as matrices.

    Per column a row of sums over its common rows with every other column comes back:
    products, own values, own squares, and how many rows there are.
    """
    used = sorted({k for pair in pairs for k in pair})
    m = len(used)
    centred = df.select(*((as_double(df, chosen[k]) - F.lit(stats[k]["mean"])).alias(f"v{k}") for k in used))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, m, m))
        for batch in batches:
            for start in range(0, batch.num_rows, MATRIX_ROWS):
                part = batch.slice(start, MATRIX_ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns])
                there = ~np.isnan(x)
                x, n = np.where(there, x, 0.0), there.astype(float)
                total += np.stack((x.T @ x, x.T @ n, (x * x).T @ n, n.T @ n))
        rows = np.concatenate(total, axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(m), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], ["i", "sums"]
        )

    def added(rows: pa.Table) -> pa.Table:
        total = np.sum([np.array(r) for r in rows.column("sums").to_pylist()], axis=0)
        return pa.table({"i": pa.array([rows.column("i")[0].as_py()], pa.int32()), "sums": pa.array([total], pa.list_(pa.float64()))})

    schema = "i int, sums array<double>"
    total = np.zeros((m, 4 * m))
    for r in centred.mapInArrow(sums, schema).groupBy("i").applyInArrow(added, schema).collect():
        total[r["i"]] = r["sums"]
    products, own, squares, n = (total[:, k * m : (k + 1) * m] for k in range(4))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, spread = own / n, np.sqrt(np.maximum(squares / n - (own / n) ** 2, 0))
        found = (products / n - mean * mean.T) / (spread * spread.T)
    found = np.where(np.isfinite(found), found, 0.0)
    place = {k: i for i, k in enumerate(used)}
    return [float(found[place[i], place[j]]) for i, j in pairs]


def _pair_correlations(df, chosen, stats, pairs) -> list[float]:
    """One scan of the columns in ``pairs``; a few sums per pair come back."""
    used = sorted({k for pair in pairs for k in pair})
    centred = df.select(
        *((as_double(df, chosen[k]) - F.lit(stats[k]["mean"])).alias(f"v{k}") for k in used)
    )
    full = [all(stats[c]["n"] == stats[c]["rows"] for c in pair) for pair in pairs]
    aggs = []
    for k, (i, j) in enumerate(pairs):
        a, b = F.col(f"v{i}"), F.col(f"v{j}")
        aggs.append(F.sum(a * b).alias(f"ab{k}"))
        if not full[k]:
            only_a, only_b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
            aggs += [
                F.count(a * b).alias(f"n{k}"),
                F.avg(only_a).alias(f"ma{k}"),
                F.avg(only_b).alias(f"mb{k}"),
                F.stddev_pop(only_a).alias(f"sa{k}"),
                F.stddev_pop(only_b).alias(f"sb{k}"),
            ]
    row = centred.agg(*aggs).first()
    out = []
    for k, (i, j) in enumerate(pairs):
        if full[k]:
            cov, scale = row[f"ab{k}"], stats[i]["n"] * stats[i]["sd"] * stats[j]["sd"]
        else:
            n, scale = row[f"n{k}"], (row[f"sa{k}"] or 0.0) * (row[f"sb{k}"] or 0.0)
            cov = row[f"ab{k}"] / n - row[f"ma{k}"] * row[f"mb{k}"] if n else 0.0
        out.append(cov / scale if scale else 0.0)
    return out


def data_bytes(df: DataFrame) -> DataFrame:
    """``(column_name, n_bytes)``: bytes of the values themselves, fixed widths or text length."""
    parts = []
    for c in df.columns:
        dtype, col = field(df, c).dataType, non_null(df, c)
        if isinstance(dtype, T.StringType):
            size = F.octet_length(col)
        elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(col.alias("v"))))
        else:
            size = F.when(col.isNotNull(), F.lit(_WIDTHS.get(type(dtype), 8)))
        parts.append({"b": size.cast("bigint")})
    summed = melt(df, parts).groupBy(SLOT).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes"))
    return named(summed, df.columns)


def cleaning_report(df: DataFrame) -> DataFrame:
    """``(column_name, type, n_rows, n_null, duplicate_rows)``: the state after cleaning."""
    rows = null_summary(df)
    dup = frequency.duplicate_count(df).first()["duplicate_rows"]
    return rows.withColumn("duplicate_rows", F.lit(dup).cast("bigint"))


def analyze(df: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    """Every part of the table analysis, each a frame of its own.

    The values are counted once, before anything else, and the counts stored: distinct counts,
    frequent values and the summary of text columns all read them.  With ``approx`` only the text
    columns are counted.
    """
    counted = text_columns(df) if approx else df.columns
    counts = frequency.pinned_counts(df, counted) if counted else []
    return {
        "null_summary": null_summary(df),
        "high_null_columns": high_null_columns(df),
        "high_cardinality_columns": high_cardinality_columns(df, approx=approx, counts=counts),
        "frequent_values": frequency.top_values(df, text_columns(df), 3, counts)
        if text_columns(df)
        else df.sparkSession.createDataFrame(
            [], "column_name string, value string, n bigint, rank bigint"
        ),
        "data_bytes": data_bytes(df),
        "describe": describe(df, approx=approx, counts=None if approx else counts),
        "correlation": correlation(df),
    }
