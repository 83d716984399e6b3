from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import ranges


def plain(points, intervals, open_end=False):
    key = lambda x: (math.isnan(x), 0 if math.isnan(x) else x)
    inside = lambda x, a, b: key(a) <= key(x) and (key(x) < key(b) if open_end else key(x) <= key(b))
    return Counter(
        (i, j) for i, x in points if x is not None for j, a, b in intervals if a is not None and b is not None and inside(x, a, b)
    )


@pytest.mark.parametrize("open_end", [False, True])
def test_equal_to_all_pairs(spark, monkeypatch, open_end):
    monkeypatch.setattr(ranges, "BIN_POINTS", 100)
    monkeypatch.setattr(ranges, "CELL_POINTS", 5)
    monkeypatch.setattr(ranges, "PART_POINTS", 30)
    pick = random.Random(4)
    points = [(i, pick.choice([7.0, 7.0, pick.uniform(0, 100), float(pick.randrange(50))])) for i in range(600)]
    points += [(600, None), (601, math.nan), (602, math.inf), (603, -math.inf), (604, -0.0), (5, points[5][1])]
    intervals = [(j, a := pick.uniform(-5, 100), a + pick.choice([0.0, 1.0, 30.0, 200.0])) for j in range(80)]
    intervals += [(80, 7.0, 7.0), (80, 7.0, 7.0), (81, 9.0, 3.0), (82, None, 3.0), (83, 3.0, None), (84, -math.inf, math.nan), (85, 7.0, 8.0)]
    left = spark.createDataFrame(points, "i long, x double").repartition(5)
    right = spark.createDataFrame(intervals, "j long, lo double, hi double")
    got = ranges.range_join(left, right, "x", "lo", "hi", open_end=open_end)
    assert Counter((r.i, r.j) for r in got.collect()) == plain(points, intervals, open_end)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dates_timestamps_and_mixed_numbers(spark):
    day = [(i, dt.date(2024, 1, 1) + dt.timedelta(i)) for i in range(30)]
    for kind in ("date", "timestamp", "timestamp_ntz"):
        left = spark.createDataFrame(day, "i long, d date").selectExpr("i", f"cast(d as {kind}) d")
        right = left.selectExpr("i as j", "d as lo", f"cast(d + interval 2 day as {kind}) as hi")
        got = ranges.range_join(left, right, "d", "lo", "hi")
        assert {(r.i, r.j) for r in got.collect()} == {(i, j) for i in range(30) for j in range(30) if j <= i <= j + 2}
    left, right = spark.range(10).selectExpr("cast(id as int) i"), spark.range(10).selectExpr("cast(id as decimal(9, 2)) lo", "id + 0.5D hi")
    assert ranges.range_join(left, right, "i", "lo", "hi").count() == 10


def test_signed_zeros_are_equal(spark):
    left, right = spark.createDataFrame([(-0.0,), (0.0,)], "x double"), spark.createDataFrame([(0.0, 0.0), (-0.0, -0.0)], "lo double, hi double")
    assert ranges.range_join(left, right, "x", "lo", "hi").count() == 4


def test_empty_sides_and_errors(spark):
    some, none = spark.range(3).toDF("x"), spark.range(0).toDF("x")
    spans = spark.range(3).selectExpr("id as lo", "id + 1 as hi")
    assert ranges.range_join(none, spans, "x", "lo", "hi").count() == 0
    assert ranges.range_join(some, spans.limit(0), "x", "lo", "hi").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        ranges.range_join(some, spans.withColumn("X", spans.lo), "x", "lo", "hi")
    with pytest.raises(ValueError, match="no order"):
        ranges.range_join(some.selectExpr("cast(x as string) x"), spans, "x", "lo", "hi")


@pytest.mark.parametrize("open_end", [False, True])
def test_counts_equal_to_all_pairs(spark, open_end):
    pick = random.Random(5)
    points = [(i, pick.choice([7.0, 7.0, pick.uniform(0, 100), float(pick.randrange(50))])) for i in range(400)]
    points += [(400, None), (401, math.nan), (402, math.inf), (403, -math.inf), (404, -0.0), (405, math.nan)]
    intervals = [(j, a := pick.choice([pick.uniform(-5, 100), 7.0]), a + pick.choice([0.0, 1.0, 30.0, 200.0])) for j in range(80)]
    intervals += [(80, 7.0, 7.0), (80, 7.0, 7.0), (81, 9.0, 3.0), (82, None, 3.0), (83, 3.0, None), (84, -math.inf, math.nan), (85, 0.0, 8.0)]
    intervals += [(86, math.nan, math.nan), (87, 500.0, 600.0), (None, 1.0, 20.0)]
    left = spark.createDataFrame(points, "i long, x double").repartition(5)
    right = spark.createDataFrame(intervals, "j long, lo double, hi double")
    rows = ranges.range_counts(left, right, "x", "lo", "hi", open_end=open_end).collect()
    pairs = ranges.range_join(left, right, "x", "lo", "hi", open_end=open_end).groupBy("j", "lo", "hi")
    pairs = pairs.agg(F.count("*").alias("n"), F.min("x").alias("least")).collect()
    copies = Counter(str((r.j, r.lo, r.hi)) for r in rows)
    assert sum(copies.values()) == len(intervals)
    assert {str((r.j, r.lo, r.hi, r.n * copies[str((r.j, r.lo, r.hi))], r.least)) for r in rows if r.n} == {str(tuple(r)) for r in pairs}
    assert all(r.least is None for r in rows if not r.n)


def test_counts_make_no_pairs(spark):
    """300,000 points and as many intervals: 7 * 10^10 pairs, more than a join could write."""
    left = spark.range(300_000).selectExpr("cast(id % 10 as int) as x")
    right = spark.range(300_000).selectExpr("id % 3 as j", "id % 5 as lo", "id % 5 + 100 as hi")
    found = ranges.range_counts(left, right, "x", "lo", "hi").agg(F.sum("n"), F.min("least"), F.max("least")).first()
    assert tuple(found) == (60_000 * 30_000 * (10 + 9 + 8 + 7 + 6), 0, 4)


def test_counts_without_rows_or_with_taken_names(spark):
    some = spark.createDataFrame([(5,)], "x int")
    spans = spark.createDataFrame([(1, 9)], "lo int, hi int")
    assert [tuple(r) for r in ranges.range_counts(some.limit(0), spans, "x", "lo", "hi").collect()] == [(1, 9, 0, None)]
    assert ranges.range_counts(some, spans.limit(0), "x", "lo", "hi").count() == 0
    with pytest.raises(ValueError, match="taken"):
        ranges.range_counts(some, spans.withColumn("N", spans.lo), "x", "lo", "hi")


def test_long_intervals_have_few_copies(spark, tmp_path, monkeypatch):
    """Intervals that hold 2,000 points each: a copy per 10 points would be 200 of each."""
    monkeypatch.setattr(ranges, "CELL_POINTS", 10)
    monkeypatch.setattr(ranges, "BIN_POINTS", 20_000)
    spark.range(20_000).selectExpr("id as x").write.parquet(str(tmp_path / "p"))
    left = spark.read.parquet(str(tmp_path / "p"))
    right = spark.range(50).selectExpr("id as j", "id * 300 as lo", "id * 300 + 1999 as hi")
    bounds = right.selectExpr("cast(lo as double) _lo", "cast(hi as double) _hi")
    dealt = ranges._binned(left.selectExpr("cast(x as double) _x"), [], "_x", "_bin")
    cells = ranges._cells(dealt, [], ranges._lengths(bounds, []))
    assert cells.agg(F.max("_many")).first()[0] == 20_000 * ranges.CELLS_EACH // 2_000
    pairs = ranges.range_join(left, right, "x", "lo", "hi")
    assert pairs.count() == 50 * 2_000 and pairs.where("x < lo or x > hi").count() == 0
    assert ranges.is_scan(left) and "checkpoint" not in "".join(pairs.inputFiles())


def test_a_full_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PART_POINTS", 7)
    left = spark.range(100).selectExpr("id as i", "id % 3 as x")
    right = spark.createDataFrame([(1, 1), (0, 2)], "lo int, hi int")
    assert sorted(map(tuple, ranges.range_join(left, right, "x", "lo", "hi").groupBy("lo").count().collect())) == [(0, 100), (1, 33)]
