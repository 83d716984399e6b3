"""Distinct rows by fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from millrace.operators import fingerprints as fp
from queries.base import table
from tests.conftest import DATA


def _rows(df):
    return sorted(str(r).replace("-0.0", "0.0") for r in df.collect())  # equal, and either may stay


def _odd(spark):
    rows = [(None, "a", 0.0), ("a", None, -0.0), (None, "a", -0.0), (None, None, math.nan), (None, None, math.nan), ("", "", None)]
    return spark.createDataFrame(rows + [(str(i % 70), "x", float(i % 3)) for i in range(500)], "a string, b string, `c d` double")


def test_like_distinct(spark):
    for df in (_odd(spark), _odd(spark).repartition(7), _odd(spark).limit(0), _odd(spark).where("b is null")):
        assert fp.distinct_rows(df).exceptAll(df.distinct()).count() == 0
        assert fp.distinct_rows(df).count() == df.distinct().count()
        got = fp.count_copies(df).first()
        assert (got.n_rows, got.n_distinct) == (df.count(), df.distinct().count())
        assert got.n_copies == got.n_rows - got.n_distinct
        assert got.largest_group == df.groupBy(*(f"`{c}`" for c in df.columns)).count().agg(F.max("count")).first()[0]


def test_rows_that_share_a_fingerprint(spark, monkeypatch):
    df = _odd(spark)
    want = _rows(df.distinct())
    for shared in (lambda d: (F.lit(5).cast("long"), F.lit(5)), lambda d: (F.coalesce(F.length("b"), F.lit(9)).cast("long"), F.lit(0))):
        monkeypatch.setattr(fp, "fingerprint", shared)
        assert _rows(fp.distinct_rows(df)) == want


def test_rows_without_copies_stay(spark, monkeypatch):
    df = table(spark, DATA, "lineitem")
    some = df.where("l_orderkey % 50 = 0")
    both = df.unionByName(some)
    alone, copied = fp.parted(both)
    assert alone.count() + copied.count() == both.count()
    assert 2 * some.count() <= copied.count() < 0.2 * both.count()
    assert copied.intersect(some).count() == some.distinct().count()
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_" not in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(fp, "BITS_PER_GROUP", 1)  # bitmaps that are far too small cost rows, not results
    assert fp.distinct_rows(both).count() == df.distinct().count()
