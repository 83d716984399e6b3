"""Joins of points with the intervals that hold them, without an equality and without a nested loop."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.names import bare
from millrace.session import ensure_checkpoint_dir, is_scan

BIN_POINTS = 10_000  # points a bin should hold
MOST_BINS = 10_000  # bins at most: what reaches the driver is a row per bin
CELL_POINTS = 500  # points a cell should hold: bins are cut into cells of equal width, as many as they have points for
CELLS_EACH = 4  # cells that the interval of mean length should cover, if they hold CELL_POINTS or more
PART_POINTS = 1_000_000  # a cell with more points is split


def _order(df: DataFrame, name: str) -> Column:
    """The column as a double that never falls where the column rises."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return bare(name).cast("double") + F.lit(0.0)  # -0.0 is 0.0
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)").cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(bare(name)).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(bare(name)).cast("double")
    raise ValueError(f"no order for a range join: {name} is {kind.simpleString()}")


def _binned(df: DataFrame, cuts: list[float], column: str, name: str) -> DataFrame:
    ends = [-math.inf, *(cuts or [0.0]), math.inf]
    put = Bucketizer(splits=ends, inputCol=column, outputCol=f"{name}_d", handleInvalid="keep")  # NaN behind all others
    return put.transform(df).withColumn(name, F.col(f"{name}_d").cast("int")).drop(f"{name}_d")


def _lengths(intervals: DataFrame, cuts: list[float]) -> dict[int, float]:
    """The mean length of the intervals that begin in a bin."""
    length = F.col("_hi") - F.col("_lo")
    begun = _binned(intervals, cuts, "_lo", "_bin").groupBy("_bin").agg(F.avg(F.when(length < math.inf, length)))
    return {r[0]: r[1] for r in begun.collect() if r[1]}  # a row per bin


def _cells(dealt: DataFrame, cuts: list[float], lengths: dict[int, float]) -> DataFrame:
    """Per bin: its first cell's number, how many it has, where they begin and how many come to a unit of length."""
    finite = F.when(F.abs("_x") < math.inf, F.col("_x"))
    counted = dealt.groupBy("_bin").agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    found = {r[0]: r for r in counted.collect()}  # a row per bin
    rows, before = [], 0
    for number in range(max(len(cuts), 1) + 2):  # the last is for NaN
        r = found.get(number)
        many, low, scale = 1, 0.0, 0.0
        if r and r.low is not None and r.high > r.low:
            wanted = max(1, r.n // CELL_POINTS)
            if number in lengths:  # an interval's copies cost more than the points its end cells hold in vain
                wanted = max(1, int(min(wanted, CELLS_EACH * (r.high - r.low) / lengths[number])))
            if wanted > 1 and math.isfinite(wanted / (r.high - r.low)) and math.isfinite(r.high - r.low):
                many, low, scale = wanted, r.low, wanted / (r.high - r.low)
        rows.append((number, before, many, low, scale))
        before += many
    return dealt.sparkSession.createDataFrame(rows, "_of int, _before long, _many long, _low double, _scale double")


def _placed(df: DataFrame, cuts: list[float], cells: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the cell of ``column``, which never falls where the column rises."""
    at = F.least(F.greatest((F.col(column) - F.col("_low")) * F.col("_scale"), F.lit(0.0)), F.col("_many") - F.lit(1.0))
    inner = F.when(F.col("_many") == 1, F.lit(0).cast("long")).otherwise(at.cast("long"))
    joined = _binned(df, cuts, column, "_bin").join(F.broadcast(cells), F.col("_bin") == F.col("_of"))
    return joined.withColumn(name, F.col("_before") + inner).drop("_bin", column, *cells.columns)


def range_join(points: DataFrame, intervals: DataFrame, point: str, start: str, stop: str, *, open_end: bool = False) -> DataFrame:
    """Every pair of a row of ``points`` and a row of ``intervals`` with ``start <= point <= stop``.

    A bounded quantile sketch of the points gives bins of about equal depth, and their counts cut each bin into
    cells of equal width.  A point goes to its cell, an interval to each cell it touches; cells are joined by
    equality and every pair is checked on the values themselves.  Where the intervals that begin in a bin hold many points,
    its cells are wider, so that an interval of mean length covers ``CELLS_EACH`` of them and has few copies; the points checked in
    vain in its end cells are then no more than a share of the result.  A cell that holds many points, such as
    one value that fills a third of the table, is split into parts that each meet the cell's intervals.

    Points that are no mere scan are pinned by a checkpoint, so a part never changes when a task is run again.  Both sides must be of
    one ordered type family (numbers, dates or timestamps).  With ``open_end`` the end is left out.  NULL in a point
    or a bound and bounds in wrong order meet nothing; NaN is greater than any number; repeated rows give repeated
    pairs; an empty side gives an empty table.  Columns of equal name on both sides are an error.
    """
    spark = points.sparkSession
    twice = {c.lower() for c in points.columns} & {c.lower() for c in intervals.columns}
    if twice:
        raise ValueError(f"columns on both sides: {sorted(twice)}")
    ensure_checkpoint_dir(spark)
    kept = points.where(bare(point).isNotNull()).withColumns({"_x": _order(points, point), "_at": F.monotonically_increasing_id()})
    kept = kept if is_scan(kept) else kept.checkpoint()
    total = kept.count()
    bins = max(1, min(MOST_BINS, total // BIN_POINTS))
    cuts = sorted({c for c in kept.approxQuantile("_x", [i / bins for i in range(1, bins)], 0.25 / bins) if math.isfinite(c)}) if bins > 1 else []
    right = intervals.where(bare(start) <= bare(stop)).withColumns({"_lo": _order(intervals, start), "_hi": _order(intervals, stop)})
    cells = _cells(_binned(kept, cuts, "_x", "_bin"), cuts, _lengths(right, cuts))
    left = _placed(kept, cuts, cells, "_x", "_cell")
    right = _placed(_placed(right, cuts, cells, "_lo", "_first"), cuts, cells, "_hi", "_last")
    right = right.withColumn("_touched", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    # fewer than one row per PART_POINTS points
    counted = left.groupBy("_cell").count().where(F.col("count") > PART_POINTS)
    found = [tuple(r) for r in counted.select("_cell", F.ceil(F.col("count") / PART_POINTS)).collect()]
    same = F.col("_cell") == F.col("_touched")
    if found:
        full = F.broadcast(spark.createDataFrame(found, "_full long, _parts long"))
        parts = F.coalesce("_parts", F.lit(1).cast("long"))
        left = left.join(full, F.col("_cell") == F.col("_full"), "left").withColumn("_part", F.pmod("_at", parts)).drop("_full", "_parts")
        right = right.join(full, F.col("_touched") == F.col("_full"), "left")
        right = right.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_full", "_parts")
        same = same & (F.col("_part") == F.col("_share"))
    inside = (bare(point) >= bare(start)) & (bare(point) < bare(stop) if open_end else bare(point) <= bare(stop))
    # a merge streams the points in their order, whatever side is small
    met = left.drop("_at").join(right.hint("merge"), same & inside)
    return met.select(*(bare(c) for c in (*points.columns, *intervals.columns)))


def range_counts(points: DataFrame, intervals: DataFrame, point: str, start: str, stop: str, *, open_end: bool = False) -> DataFrame:
    """``intervals`` with ``n``, how many points have ``start <= point <= stop``, and ``least``, the smallest of them.

    For questions about the pairs of ``range_join`` that need no pair: their number may be the product of both tables, while this
    sorts each distinct value once.  Counted points and distinct bounds are put in one order by range partitions, pinned by a
    checkpoint; the points before a bound are those of earlier partitions and those before it in its own, and the points of an
    interval are the difference between its bounds.  A value that fills a third of either table is one row there; intervals
    are joined with their bounds by equality, on a side that is unique per key.

    Types, NULL, NaN and ``open_end`` are as in ``range_join``; an interval that meets nothing has 0 and NULL.
    """
    spark = points.sparkSession
    for df, c in ((points, point), (intervals, start), (intervals, stop)):
        _order(df, c)  # refuses what has no order
    taken = {c.lower() for c in intervals.columns} & {"n", "least"}
    if taken:
        raise ValueError(f"the column names {sorted(taken)} are taken")
    ensure_checkpoint_dir(spark)
    after = 0 if open_end else 2  # where an end stands among equal points, which have 1
    counted = points.select(bare(point).alias("_v")).where("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    sound = intervals.where(bare(start) <= bare(stop))
    bounds = sound.select(bare(start).alias("_v"), F.lit(0).alias("_kind")).union(sound.select(bare(stop), F.lit(after))).distinct()
    told = counted.select("_v", F.lit(1).alias("_kind"), "_n").union(bounds.select("_v", "_kind", F.lit(0).cast("long")))
    kept = told.repartitionByRange("_v", "_kind").withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    kept = kept.withColumn("_part", F.shiftright("_at", 33)).withColumn("_point", F.when(F.col("_kind") == 1, F.col("_v")))

    in_order = Window.orderBy("_of")  # over a row per partition
    parts = kept.groupBy(F.col("_part").alias("_of")).agg(F.sum("_n").alias("_all"), F.min("_point").alias("_first"))
    parts = parts.select(
        "_of",
        F.coalesce(F.sum("_all").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.first("_first", ignorenulls=True).over(in_order.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    own = Window.partitionBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = kept.withColumn("_own", F.sum("_n").over(own.orderBy("_v", "_kind")))
    placed = placed.withColumn("_next", F.last("_point", ignorenulls=True).over(own.orderBy(F.desc("_v"), F.desc("_kind"))))
    placed = placed.where("_kind <> 1").join(F.broadcast(parts), F.col("_part") == F.col("_of"))
    placed = placed.select("_v", "_kind", (F.col("_before") + F.col("_own")).alias("_seen"), F.coalesce("_next", "_later").alias("_next"))

    value = told.schema["_v"].dataType
    begun = placed.where("_kind = 0").select(F.col("_v").alias("_from"), F.col("_seen").alias("_seen_from"), "_next")
    ended = placed.where(F.col("_kind") == after).select(F.col("_v").alias("_to"), F.col("_seen").alias("_seen_to"))
    asked = intervals.withColumns({"_a": bare(start).cast(value), "_b": bare(stop).cast(value), "_sound": bare(start) <= bare(stop)})
    met = asked.join(begun, F.col("_sound") & (F.col("_a") == F.col("_from")), "left").join(
        ended, F.col("_sound") & (F.col("_b") == F.col("_to")), "left"
    )
    n = F.coalesce(F.col("_seen_to") - F.col("_seen_from"), F.lit(0).cast("long"))
    return met.select(*(bare(c) for c in intervals.columns), n.alias("n"), F.when(n > 0, F.col("_next")).alias("least"))
