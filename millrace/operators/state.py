"""Mergeable state of a growing table: what batches were like, kept so that old rows need not be read again.

``add_batch`` keeps one row per column and batch: counts, mean and squared deviations, extremes, an HLL sketch for distinct
values and a KLL sketch for quantiles; and the batch's most frequent values with the largest count that
was left out.  ``merged`` adds any number of them up:

* counts, extremes, means and deviations are those of all rows (to rounding),
* distinct values within ``HLL_ERROR`` (three standard errors), ranks of quantiles within ``KLL_ERROR`` of the rows,
* the count of a frequent value lies between ``n`` and ``n_most``: what each batch that does not list it left out may be missing.

A batch is a partition of the state's tables, and adding one again replaces it, so a job that is repeated after a
failure counts nothing twice.  ``compact`` folds all batches into one of the same form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.heavy import frequent_values
from millrace.operators.longform import SLOT, as_double, field, is_number, melt, named, non_null
from millrace.session import scratch_path

LG_K = 13
HLL_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
KLL_K = 800
KLL_ERROR = 0.005
HITTERS = 200
STATS = (
    "column_name string, type string, n_rows bigint, n_null bigint, n bigint, mean double, m2 double, "
    "low double, high double, distinct_sketch binary, quantile_sketch binary, left_out bigint"
)
VALUES = "column_name string, value string, n bigint, n_most bigint"


def _numeric(df: DataFrame, c: str) -> bool:
    kind = field(df, c).dataType
    return is_number(kind) or isinstance(kind, T.BooleanType)


def batch_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column, in one pass; only sketches and sums are shuffled."""
    parts = []
    for c in columns:
        value = non_null(df, c)
        plain = isinstance(field(df, c).dataType, T.AtomicType)
        parts.append(
            {
                "h": F.xxhash64(value if plain else F.to_json(F.struct(value.alias("v")))),
                "there": value.isNotNull(),
                "x": as_double(df, c) if _numeric(df, c) else F.lit(None).cast("double"),
            }
        )
    x = F.col("x")
    found = melt(df, parts).groupBy(SLOT).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("there")).alias("n_null"), F.count(x).alias("n"),
        F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.hll_sketch_agg(F.when(F.col("there"), F.col("h")), LG_K).alias("distinct_sketch"),
        F.kll_sketch_agg_double(x, KLL_K).alias("quantile_sketch"),
    )
    kinds = F.array(*(F.lit(field(df, c).dataType.simpleString()) for c in columns))
    return named(found.withColumn("type", F.get(kinds, F.col(SLOT))), list(columns))


def batch_values(df: DataFrame, columns: Sequence[str], hitters: int = HITTERS) -> DataFrame:
    """``(column_name, value, n, rank)`` of the batch's most frequent values, one more than are kept."""
    return frequent_values(df, columns, hitters + 1)


def add_batch(df: DataFrame, path: str, batch: str, columns: Sequence[str] | None = None, hitters: int = HITTERS) -> None:
    """Keep the state of ``df`` as ``batch`` below ``path``."""
    columns = list(columns) if columns is not None else df.columns
    # written once, a few rows per column: counting them again for ``left_out`` would count most of the batch again
    values = batch_values(df, columns, hitters)
    kept = scratch_path(df.sparkSession, "batch-values")
    values.write.parquet(kept)
    values = df.sparkSession.read.schema(values.schema).parquet(kept)
    _write(values.where(F.col("rank") <= hitters).withColumn("n_most", F.col("n")).drop("rank"), f"{path}/values", batch)
    # What is left out is at most as frequent as the first value beyond the kept ones.
    beyond = values.where(F.col("rank") == hitters + 1).select("column_name", F.col("n").alias("left_out"))
    stats = batch_stats(df, columns).join(beyond, "column_name", "left")
    _write(stats.withColumn("left_out", F.coalesce("left_out", F.lit(0).cast("bigint"))), f"{path}/stats", batch)


def _write(df: DataFrame, path: str, batch: str) -> None:
    dated = df.withColumn("batch", F.lit(batch))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The kept rows of all batches: (stats, values)."""
    return (
        spark.read.schema(f"{STATS}, batch string").parquet(f"{path}/stats"),
        spark.read.schema(f"{VALUES}, batch string").parquet(f"{path}/values"),
    )


def merged_stats(stats: DataFrame) -> DataFrame:
    """All batches of ``stats`` as one.  Deviations are added about the mean of all rows."""
    n, mean = F.col("n"), F.col("mean")
    whole = stats.groupBy("column_name").agg((F.sum(n * mean) / F.sum(F.when(mean.isNotNull(), n))).alias("all_mean"))
    about = stats.join(whole, "column_name")
    off = mean - F.col("all_mean")
    return about.groupBy("column_name").agg(
        F.max("type").alias("type"), *(F.sum(c).alias(c) for c in ("n_rows", "n_null", "n")),
        F.first("all_mean").alias("mean"), F.sum(F.col("m2") + n * off * off).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch", KLL_K).alias("quantile_sketch"),
        F.sum("left_out").alias("left_out"),
    )


def merged_values(stats: DataFrame, values: DataFrame) -> DataFrame:
    """``(column_name, value, n, n_most)``: the counts of all batches that list a value, and the most it can have."""
    all_out = stats.groupBy("column_name").agg(F.sum("left_out").alias("all_out"))
    listed = values.join(stats.select("column_name", "batch", "left_out"), ["column_name", "batch"])
    found = listed.groupBy("column_name", "value").agg(*(F.sum(c).alias(c) for c in ("n", "n_most")), F.sum("left_out").alias("out"))
    most = F.col("n_most") + F.col("all_out") - F.col("out")
    return found.join(all_out, "column_name").select("column_name", "value", "n", most.alias("n_most"))


def compact(spark: SparkSession, path: str, target: str, batch: str = "all", hitters: int = HITTERS) -> None:
    """The state below ``path`` as a single batch below ``target``, with ``hitters`` values for each column."""
    stats, values = load(spark, path)
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")  # over what the batches listed
    ranked = merged_values(stats, values).withColumn("rank", F.row_number().over(order))
    _write(ranked.where(F.col("rank") <= hitters).drop("rank"), f"{target}/values", batch)
    gone = ranked.where(F.col("rank") > hitters).groupBy("column_name").agg(F.max("n_most").alias("gone"))
    whole = merged_stats(stats).join(gone, "column_name", "left")
    _write(whole.withColumn("left_out", F.greatest("left_out", F.coalesce("gone", F.lit(0)))).drop("gone"), f"{target}/stats", batch)


def quantiles(shares: Sequence[float]) -> Column:
    """The values at ``shares`` of the rows, from a row's sketch; NULL without numbers."""
    found = F.kll_sketch_get_quantile_double("quantile_sketch", F.array(*(F.lit(float(s)) for s in shares)))
    return F.when(F.col("n") > 0, found)


def profile(spark: SparkSession, path: str, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column over all batches; reads the state only."""
    stats, values = load(spark, path)
    spread = F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1))
    top = merged_values(stats, values).groupBy("column_name").agg(
        F.min(F.struct((-F.col("n")).alias("minus"), "value", "n_most")).alias("best")
    )
    return merged_stats(stats).join(top, "column_name", "left").select(
        "column_name", "type", "n_rows", "n_null", F.col("n").alias("count"), "mean", spread.alias("std"),
        F.col("low").alias("min"), F.col("high").alias("max"), F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"),
        quantiles(shares).alias("quantiles"), F.col("best.value").alias("top"), (-F.col("best.minus")).alias("freq"), F.col("best.n_most").alias("freq_most"),
    )
