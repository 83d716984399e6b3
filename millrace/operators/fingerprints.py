"""Distinct rows and copies of wide tables: fingerprints are shuffled, rows only where they may have copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.names import bare
from millrace.session import ensure_checkpoint_dir

PAGE = 32_768  # bits of one bitmap, fixed by Spark's bitmap functions
PAGES = 16_384  # 64 MB of bitmaps at most are broadcast
BITS_PER_GROUP = 16


def fingerprint(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of a row.  Equal rows agree in them; rows that agree need not be equal."""
    columns = [bare(c) for c in df.columns]
    return F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)


def parted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that have no copy, rows that may have some): two parts of ``df``, lazily, neither shuffled.

    Fingerprints are counted, map-side first; those that occur more than once set a bit in bitmaps that are
    broadcast (``BITS_PER_GROUP`` bits a fingerprint, ``PAGES`` pages at most) and tell the parts on a second scan.
    A bit may be set by another fingerprint, so some rows without copies land in the second part: about one in sixteen
    up to 32 million groups of copies, more beyond; that costs time and never changes a result.
    ``df`` is evaluated twice and must give the same rows each time.
    """
    taken = {"_p", "_page", "_map", "_byte", "_copied"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"column names used inside: {sorted(taken)}")
    ensure_checkpoint_dir(df.sparkSession)
    one, two = fingerprint(df)
    counted = df.select(one.alias("_f1"), two.alias("_f2")).groupBy("_f1", "_f2").agg(F.count(F.lit(1)).alias("_n"))
    copied = counted.where("_n > 1").select("_f1").checkpoint()
    pages = min(PAGES, max(1, -(-copied.count() * BITS_PER_GROUP // PAGE)))
    place = F.pmod(one, F.lit(pages * PAGE))
    page, bit = F.expr(f"_p div {PAGE}"), F.expr(f"_p % {PAGE}")
    maps = copied.select(F.pmod("_f1", F.lit(pages * PAGE)).alias("_p")).groupBy(page.alias("_page"))
    maps = F.broadcast(maps.agg(F.bitmap_construct_agg(bit).alias("_map")))
    placed = df.withColumn("_p", place).join(maps, page == F.col("_page"), "left")
    byte = F.conv(F.hex(F.substring("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = F.coalesce(F.expr("shiftright(_byte, cast(_p % 8 as int)) & 1") == 1, F.lit(False))
    told = placed.withColumn("_byte", byte).withColumn("_copied", known)
    names = [bare(c) for c in df.columns]
    return told.where(~F.col("_copied")).select(*names), told.where("_copied").select(*names)


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df.distinct()``; whole rows are shuffled, and compared by value, only where they may have copies."""
    alone, copied = parted(df)
    return alone.unionByName(copied.dropDuplicates())


def count_copies(df: DataFrame) -> DataFrame:
    """One row: the rows, the distinct rows, the rows beyond the first of each kind, and the greatest group of copies."""
    alone, copied = parted(df)
    groups = copied.groupBy(*(bare(c) for c in df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    counted = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("b"), F.max("_n").alias("c"))
    both = alone.agg(F.count(F.lit(1)).alias("a"), F.count(F.lit(1)).alias("b"), F.when(F.count(F.lit(1)) > 0, F.lit(1)).cast("long").alias("c")).unionAll(counted)
    return both.agg(
        F.sum("a").alias("n_rows"), F.sum("b").alias("n_distinct"), (F.sum("a") - F.sum("b")).alias("n_copies"), F.max("c").alias("largest_group")
    )
