"""Candidates for frequent values, and state that batches are merged from."""

from __future__ import annotations

import bisect
import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.operators import frequency, heavy, state
from millrace.plans.config import CleanerConfig
from millrace.plans.fit import fit
from millrace.plans.refresh import keep_batch, refreshed
from millrace.session import scratch_path
from queries.base import dirty_orders
from tests.conftest import DATA


@pytest.fixture(scope="module")
def mixed(spark):
    """Skewed, even, unique, tied, empty and constant columns of several types."""
    i = F.col("id")
    skewed = F.floor(F.pow(F.pmod(F.xxhash64(i), F.lit(10_000)) / 10_000.0, 4) * 3000)
    return spark.range(6000).select(
        skewed.cast("long").alias("skewed"), (i % 700).cast("double").alias("even"), i.alias("unique"), (i % 2 == 0).alias("flag"),
        F.concat(F.lit("t"), F.when(i % 3 == 0, 0).otherwise(i)).alias("hot"), F.lit(None).cast("string").alias("none"),
        F.when(i % 5 > 0, (i % 11).cast("int")).alias("gaps"), F.array(i % 4).alias("list"), F.lit("x").alias("same"),
    )


@pytest.mark.parametrize(("k", "buckets"), [(1, 8192), (5, 8192), (5, 70), (100, 300)])
def test_same_as_counting_everything(mixed, k, buckets):
    key = lambda rows: sorted(map(tuple, rows))
    got = heavy.frequent_values(mixed, mixed.columns, k, buckets).collect()
    assert key(got) == key(frequency.top_values(mixed, mixed.columns, k).collect())


def test_no_rows(mixed):
    assert heavy.frequent_values(mixed.limit(0), mixed.columns).count() == 0


def test_few_values_are_counted(spark):
    """Of 40,000 distinct values only those in full buckets are shuffled."""
    i = F.col("id")
    df = spark.range(60_000).select(F.when(i % 3 == 0, i % 20).otherwise(i + 100).alias("v"))
    sizes = heavy.bucket_sizes(df, ["v"])
    assert sizes.count() <= heavy.BUCKETS
    best = heavy.frequent_values(df, ["v"], 5)
    limit = best.agg(F.min("n")).first()[0]
    chosen = sizes.where((F.col("n") >= limit)).select("slot", "bucket")
    assert chosen.count() < 100
    assert heavy.counted(df, ["v"], chosen).count() < 1000


@pytest.fixture(scope="module")
def kept(spark, mixed):
    path = scratch_path(spark, "state")
    for b in range(3):
        state.add_batch(mixed.where(F.col("unique") % 3 == b), path, f"b{b}", hitters=30)
    state.add_batch(mixed.where(F.col("unique") % 3 == 1), path, "b1", hitters=30)  # once more, as after a failure
    return path


def test_merged_like_one_batch(spark, mixed, kept):
    one = scratch_path(spark, "state")
    state.add_batch(mixed, one, "all")
    small = scratch_path(spark, "state")
    state.compact(spark, kept, small)
    plain = {r.column_name: r for r in state.profile(spark, one).collect()}
    for path in (kept, small):
        for r in state.profile(spark, path).collect():
            want = plain[r.column_name]
            assert r[1:5] == want[1:5] and (r.min, r.max) == (want.min, want.max)
            assert (r.mean, r.std) == (pytest.approx(want.mean), pytest.approx(want.std))
            assert r.n_distinct == pytest.approx(want.n_distinct, rel=2 * state.HLL_ERROR)


def test_within_the_stated_bounds(spark, mixed, kept):
    rows = mixed.collect()
    for r in state.profile(spark, kept, (0.0, 0.1, 0.5, 0.9, 1.0)).collect():
        values = [x[r.column_name] for x in rows if x[r.column_name] is not None]
        true = len({str(v) for v in values})
        assert abs(r.n_distinct - true) <= state.HLL_ERROR * true + 1
        if r["count"]:
            order = sorted(map(float, values))
            assert (r.mean, r.std) == (pytest.approx(statistics.fmean(order)), pytest.approx(statistics.stdev(order)))
            for share, q in zip((0.0, 0.1, 0.5, 0.9, 1.0), r.quantiles, strict=True):
                low, high = bisect.bisect_left(order, q) / len(order), bisect.bisect_right(order, q) / len(order)
                assert low - state.KLL_ERROR <= share <= high + state.KLL_ERROR


def test_counts_of_frequent_values_lie_between(spark, mixed, kept):
    true = {(r[0], r[1]): r[2] for r in frequency.top_values(mixed, mixed.columns, 10_000).collect()}
    small = scratch_path(spark, "state")
    state.compact(spark, kept, small, hitters=20)
    for path in (kept, small):
        stats, values = state.load(spark, path)
        found = {(r.column_name, r.value): (r.n, r.n_most) for r in state.merged_values(stats, values).collect()}
        assert all(n <= true[key] <= most for key, (n, most) in found.items())
        assert found["hot", "t0"] == (2000, 2002)  # two batches left out values seen once
        assert found["flag", "true"] == (3000, 3000)
        # no value that is missing is more frequent than what was left out
        out = {r[0]: r[1] for r in stats.groupBy("column_name").agg(F.sum("left_out")).collect()}
        assert all(n <= out[key[0]] for key, n in true.items() if key not in found)
    assert values.groupBy("column_name").count().agg(F.max("count")).first()[0] == 20


def test_a_refreshed_plan_is_like_a_new_fit(spark):
    df = dirty_orders(spark, DATA)
    cfg = CleanerConfig(winsorize_exclude_ids=True, categorical_strategy="mode")
    plan = fit(df.where("o_orderkey % 4 = 0"), cfg)
    path = scratch_path(spark, "state")
    for b in range(4):
        keep_batch(plan, df.where(f"o_orderkey % 4 = {b}"), path, f"b{b}")
    new, whole = refreshed(plan, spark, path), fit(df, cfg)
    order = sorted(r[0] for r in df.select("price").where("price is not null").collect())
    rank = lambda v: bisect.bisect(order, v) / len(order)
    for got, want in zip((*new.bounds["price"], new.medians["price"]), (*whole.bounds["price"], whole.medians["price"]), strict=True):
        assert abs(rank(got) - rank(want)) <= state.KLL_ERROR + 1 / len(order)
    assert new.moments["price"] == pytest.approx(whole.moments["price"], rel=0.02)
    assert new.fills == whole.fills and new.transform(df).columns == plan.transform(df).columns
    assert plan.medians["price"] != new.medians["price"]


def test_frequent_values_of_a_batch_are_counted_once(spark, tmp_path, monkeypatch):
    written = []
    write = state._write
    monkeypatch.setattr(state, "_write", lambda df, path, batch: (written.append(df), write(df, path, batch)))
    state.add_batch(spark.range(1_000), str(tmp_path / "s"), "b0", hitters=5)
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 1000") for df in written]
    assert scans == [0, 1]  # the kept values, and one pass for the statistics
    stats, values = state.load(spark, str(tmp_path / "s"))
    assert values.count() == 5 and stats.first().left_out == 1
