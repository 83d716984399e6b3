"""Exact most frequent values without shuffling all distinct ones.

Every value falls into one of ``BUCKETS`` by hash, and no value is more frequent than its bucket is full.  So
the bucket sizes, a table of bounded size that tasks add up before they shuffle, bound what is not counted:

1. count the buckets,
2. count the values of the fullest buckets exactly; the k-th of them gives a threshold,
3. buckets that are not below the threshold could hold a better or an equal value: count those too, if there are any.

What is shuffled are bucket sizes and the distinct values of the counted buckets.  Columns without frequent
values (a key, say) have no threshold above one, and then all values are counted, as they must be.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.frequency import by_family, key_of, shown_by_slot
from millrace.operators.longform import SLOT, melt, named
from millrace.session import scratch_path

BUCKETS = 8_192
FULLEST = 64  # buckets counted at first, and at least four for each wanted value
COLUMNS = 64  # columns handled at once: their bucket table has 500,000 rows at most


def _keyed(df: DataFrame, names: Sequence[str], buckets: int) -> DataFrame:
    """``(slot, value, bucket)`` of the non-null values."""
    values = melt(df, [{"value": key_of(df, c)} for c in names]).where(F.col("value").isNotNull())
    return values.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))


def bucket_sizes(df: DataFrame, names: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``(slot, bucket, n)``, stored: at most ``buckets`` rows for each column."""
    path = scratch_path(df.sparkSession, "buckets")
    _keyed(df, names, buckets).groupBy(SLOT, "bucket").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(f"{SLOT} int, bucket int, n bigint").parquet(path)


def counted(df: DataFrame, names: Sequence[str], chosen: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(slot, value, n)`` of the values in the chosen buckets."""
    side = F.broadcast(chosen.select(F.col(SLOT).alias("s_"), F.col("bucket").alias("b_")))  # bounded by COLUMNS x BUCKETS
    kept = _keyed(df, names, buckets).join(side, (F.col(SLOT) == F.col("s_")) & (F.col("bucket") == F.col("b_")))
    return kept.groupBy(SLOT, "value").agg(F.count(F.lit(1)).alias("n"))


def _best(counts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy(SLOT).orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _frequent(df: DataFrame, names: Sequence[str], k: int, buckets: int) -> DataFrame:
    spark = df.sparkSession
    sizes = bucket_sizes(df, names, buckets)
    fullness = Window.partitionBy(SLOT).orderBy(F.desc("n"), "bucket")  # over at most ``buckets`` rows
    first = sizes.withColumn("place", F.row_number().over(fullness)).where(F.col("place") <= max(FULLEST, 4 * k))
    path = scratch_path(spark, "frequent")
    best = _best(counted(df, names, first, buckets), k)
    best.write.parquet(path)
    best = spark.read.schema(best.schema).parquet(path)
    # one row per column: the count that another value must reach
    limits = best.where(F.col("rank") == k).select(F.col(SLOT).alias("l_"), F.col("n").alias("limit"))
    wanted = sizes.join(F.broadcast(limits), F.col(SLOT) == F.col("l_"), "left").where(F.col("n") >= F.coalesce("limit", F.lit(0)))
    more = wanted.join(F.broadcast(first.select(SLOT, "bucket")), [SLOT, "bucket"], "left_anti").select(SLOT, "bucket")
    if not more.limit(1).count():
        return best
    return _best(best.select(SLOT, "value", "n").unionByName(counted(df, names, more, buckets)), k)


def frequent_values(df: DataFrame, columns: Sequence[str], k: int = 5, buckets: int = BUCKETS) -> DataFrame:
    """``(column_name, value, n, rank)``: the k most frequent non-null values per column; ties go to the smaller value."""
    frames = []
    for family in by_family(df, columns):
        for at in range(0, len(family), COLUMNS):
            names = family[at : at + COLUMNS]
            best = _frequent(df, names, k, buckets)
            shown = shown_by_slot(df, names, F.col("value")).alias("value")
            frames.append(named(best.select(SLOT, shown, "n", "rank"), names))
    return reduce(DataFrame.unionByName, frames)
