"""Quantiles, frequencies and profiles against brute force, skew included."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import compare, frequency, lookup, profile, rows
from millrace.operators.quantiles import approx_quantiles, exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows share one value; some are NULL or NaN."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=3000)
    x[:1000] = 0.25
    y = rng.integers(0, 5, 3000).astype(float)
    y[::7] = np.nan
    return pd.DataFrame({"x": x, "y": y, "k": np.arange(3000)})


@pytest.mark.parametrize("gap_rows, sketch_k", [(10, 8), (50, 64), (10_000, 2000)])
@pytest.mark.parametrize("hint", [None, 3000])
def test_quantiles_are_exact(spark, skewed, gap_rows, sketch_k, hint):
    df = spark.createDataFrame(skewed).repartition(5)
    got = exact_quantiles(
        df, ["x", "y", "k"], PROBS, gap_rows=gap_rows, sketch_k=sketch_k, rows_at_most=hint
    )
    for c in got:
        assert np.allclose(got[c], skewed[c].quantile(PROBS), rtol=0, atol=1e-12)


def test_quantiles_of_nothing(spark, frame):
    df = frame("a double, b double", (None, 1.0), (None, float("nan")))
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}
    assert exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_approximate_quantiles_are_near(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = approx_quantiles(df, ["k"], [0.5])["k"][0]
    assert abs(got - 1500) < 10


def test_frequencies_under_skew(spark, skewed):
    df = spark.createDataFrame(skewed)
    top = {
        (r.column_name, r["rank"]): (float(r.value), r.n)
        for r in frequency.top_values(df, ["x", "y"], 2).collect()
    }
    assert top["x", 1] == (0.25, 1000)
    counts = skewed.y.value_counts()
    assert top["y", 1][1] == counts.max()
    distinct = {r[0]: r[1] for r in frequency.distinct_counts(df, ["x", "y", "k"]).collect()}
    assert distinct == {"x": 2001, "y": 5, "k": 3000}
    near = {r[0]: r[1] for r in frequency.distinct_counts(df, ["k"], approx=True).collect()}
    assert abs(near["k"] - 3000) < 150


def test_top_values_of_other_types(frame):
    df = frame("b boolean, a array<int>, d date", (True, [1], None), (True, [1], None))
    got = {r[0]: (r[1], r[2]) for r in frequency.top_values(df, df.columns, 1).collect()}
    assert got == {"b": ("true", 2), "a": ('{"v":[1]}', 2)}


def test_duplicates(spark, frame):
    df = frame("a int, b string", *[(1, "x")] * 50, (2, None), (2, None), (3, "y"))
    assert frequency.duplicate_count(df).first()[0] == 50
    assert frequency.duplicate_count(rows.dedupe_rows(df)).first()[0] == 0
    assert frequency.duplicate_count(df.limit(0)).first()[0] == 0
    kept = rows.dedupe_rows(df, ["a"], ["b"])
    assert sorted(map(tuple, kept.collect()), key=repr) == [(1, "x"), (2, None), (3, "y")]


def test_profile_of_edge_tables(spark, frame):
    df = frame("a double, s string", (None, None), (1.0, "x"), (float("nan"), "x"))
    got = {r.column_name: r for r in profile.profile_columns(df).collect()}
    assert got["a"].null_percent == pytest.approx(66.67)
    assert got["a"].unique_percent == 100 and got["a"].outlier_count == 0
    assert got["s"].mean is None
    assert profile.profile_columns(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="not found"):
        profile.profile_columns(df, ["zzz"])


def test_correlation_is_pairwise_complete(spark, skewed):
    data = skewed.assign(c=5.0)
    df = spark.createDataFrame(data)
    want = data.corr().fillna(0)
    got = profile.correlation(df).collect()
    assert len(got) == 16
    for r in got:
        assert r["corr"] == pytest.approx(want.loc[r.x, r.y], abs=1e-9)


def test_statistics_do_not_depend_on_partitioning(spark, skewed):
    df = spark.createDataFrame(skewed)

    def shot(d):
        return sorted(map(tuple, profile.describe(d, approx=False).collect()), key=repr)

    a, b = shot(df.repartition(1)), shot(df.repartition(7))
    assert [r[0] for r in a] == [r[0] for r in b]
    for x, y in zip(a, b):
        assert x[5:] == pytest.approx(y[5:])


def test_compare(frame):
    a, b = frame("k int, x double", (1, 2.0)), frame("k bigint, y double", (1, 3.0), (3, 1.0))
    status = {r[0]: r[1] for r in compare.compare_schema(a, b).collect()}
    assert status == {"k": "type_mismatch", "x": "only_in_1", "y": "only_in_2"}
    drift = compare.numeric_drift(a, b).collect()
    assert [(r.column_name, r.mean_1, r.mean_2, r.std_1) for r in drift] == [("k", 1.0, 2.0, None)]


def test_codes_are_sorted_ranks_over_many_partitions(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id") % 700).alias("s"))
    table, n, size = lookup.level_table(df.repartition(9), "s")
    got = [tuple(r) for r in table.orderBy("value").collect()]
    assert n == 700 and size > 0
    assert got == [(v, i) for i, v in enumerate(sorted({f"v{i}" for i in range(700)}))]


def test_codes_without_broadcast(spark, frame, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", -1)
    df = frame("s string", ("b",), ("a",), (None,), ("b",))
    got = sorted(map(tuple, lookup.dictionary_encode(df, ["s"]).collect()), key=repr)
    assert got == [("a", 0), ("b", 1), ("b", 1), (None, None)]


def test_large_synonym_maps_join(frame):
    df = frame("s string", ("K1",), ("other",), (None,))
    mapping = {f"k{i}": f"v{i}" for i in range(lookup.LITERAL_ENTRIES + 1)}
    got = [r[0] for r in lookup.apply_synonyms(df, "s", mapping).collect()]
    assert sorted(got, key=repr) == ["other", "v1", None]


def test_many_correlations_in_few_scans(spark):
    """A thousand columns, some with gaps: matrices instead of pairs."""
    n = 200
    value = lambda i: F.when(F.col("id") % (i + 3) != 0, F.pmod(F.xxhash64("id", F.lit(i % 7)), F.lit(100)) + F.col("id") * (i % 3))
    df = spark.range(300).select(*(value(i).cast("double").alias(f"c{i}") for i in range(n)))
    got = {(r.x, r.y): r.corr for r in profile.correlation(df).collect()}
    assert len(got) == n * n
    pdf = df.toPandas()
    for x, y in (("c0", "c1"), ("c5", "c12"), ("c7", "c14"), ("c0", "c199"), ("c3", "c3")):
        assert got[x, y] == pytest.approx(pdf[x].corr(pdf[y]), abs=1e-9)


def test_analysis_counts_values_once(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("a"), F.concat(F.lit("t"), F.col("id") % 5).alias("t"))
    parts = profile.analyze(df)
    plans = [parts[p]._jdf.queryExecution().toString() for p in ("high_cardinality_columns", "frequent_values", "describe")]
    assert all("value-counts" in plan for plan in plans)
    assert {r.column_name: r.n_distinct for r in profile.high_cardinality_columns(df, 0.0).collect()} == {"a": 7, "t": 5}
    top = parts["frequent_values"].where("rank = 1").first()
    assert (top.column_name, top.value, top.n) == ("t", "t0", 40)
