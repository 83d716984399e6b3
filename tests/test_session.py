"""How inputs with few splits are dealt out."""

from __future__ import annotations

from millrace import session
from millrace.session import is_scan, spread, spread_once, wanted_splits
from queries.base import table
from tests.conftest import DATA

GB = 1 << 30


def test_the_size_of_a_split_decides():
    assert wanted_splits(3 * GB, 1, 8) == 8  # a gzip file
    assert wanted_splits(2048 * GB, 1, 10_000) == 10_000
    assert wanted_splits(2048 * GB, 16, 100) == 4096
    assert wanted_splits(3 * GB, 8, 8) is None and wanted_splits(2048 * GB, 16_384, 100) is None
    assert wanted_splits(GB, 1, 8) == 8 and wanted_splits(GB, 5, 8) is None


def test_rows_stay_the_same_and_are_written_once(spark, monkeypatch):
    one = table(spark, DATA, "orders").coalesce(1)
    monkeypatch.setattr(session, "SMALL_BYTES", 0)
    monkeypatch.setattr(session, "SPLIT_BYTES", 10_000)
    dealt = spread(one)
    assert dealt.rdd.getNumPartitions() >= 8
    kept = spread_once(one)
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.schema.simpleString() == one.schema.simpleString()
    assert kept.exceptAll(one).count() == one.exceptAll(kept).count() == 0
    monkeypatch.setattr(session, "SPLIT_BYTES", 1 << 40)
    assert spread(one) is one and spread_once(one) is one


def test_scans_are_told_from_work_that_shuffles(spark):
    orders = table(spark, DATA, "orders")
    assert is_scan(orders) and is_scan(orders.where("o_custkey > 3").selectExpr("o_custkey + 1 as k"))
    assert not is_scan(orders.distinct()) and not is_scan(orders.crossJoin(orders.limit(1))) and not is_scan(spark.range(3))


def test_an_unknown_size_deals_nothing_out(spark):
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(1, "a"), (2, "b")], 1), "a long, b string")
    assert spread(rows) is rows and wanted_splits((1 << 63) - 1, 1, 8) is None
