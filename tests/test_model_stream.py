"""Model tables and streams."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from millrace.operators import model
from millrace.operators.ranks import ranked, told_apart, with_partners
from millrace.operators.rows import dedupe_rows
from millrace.plans.config import CleanerConfig
from millrace.plans.fit import fit
from millrace.session import scratch_path
from millrace.streaming import keyed
from millrace.streaming.landing import clean_stream, read_landing, write_landing
from queries.base import table
from tests.conftest import DATA


@pytest.fixture(scope="module")
def learnable(spark):
    """The text decides the target; the number is noise; some targets are unknown."""
    kind = F.element_at(F.array(*map(F.lit, ("red", "green", "blue"))), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(900).select(
        F.when(F.col("id") % 50 != 0, kind).alias("colour"),
        (F.xxhash64("id") % 100).cast("double").alias("noise"),
        F.lit(4.0).alias("still"),
        F.when(F.col("id") % 10 != 0, F.when(kind == "red", "yes").otherwise("no")).alias("answer"),
    )


def test_classification(spark, learnable):
    out = model.predict(learnable, trees=10, depth=4)
    assert out.target_column == "answer" and out.problem_type == "classification"
    assert out.predictions.count() == 900
    assert out.metrics.first().accuracy > 0.9
    ranked = [r.feature for r in out.explanation.collect()]
    assert ranked[0] == "colour" and set(ranked) == {"colour", "noise", "still"}
    assert set(r[0] for r in out.predictions.select("answer_prediction").distinct().collect()) <= {"yes", "no"}


def test_regression(spark):
    df = spark.range(500).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 97 * 2.0).alias("y"))
    forest = model.train_forest(df, "y", trees=10, depth=6)
    assert forest.kind == "regression" and forest.metrics().first().rmse < 20
    assert forest.tree_importance().first().feature == "a"
    assert forest.score(df.drop("y")).columns == ["a", "y_prediction"]


def test_many_rows_of_few_cells_are_counted_for_training(spark, monkeypatch):
    """A long table is learnt from weighted cells that keep counts, sums and squares; numbers, gaps and classes."""
    df = spark.range(40_000).selectExpr(
        "id % 40 as a", "case when id % 7 > 0 then pmod(xxhash64(id), 1000) end as b", "id as key", "concat('t', id % 3) as c",
        "id % 40 * 10 + id % 3 + id % 11 * 0.5 as y", "concat('class ', id % 40 div 20) as kind", "timestamp_seconds(id) as at",
    )
    seen, cells = [], model._cells
    monkeypatch.setattr(model, "_cells", lambda forest, rows: seen.append((rows, cells(forest, rows))) or seen[-1][1])
    forest = model.train_forest(df.drop("kind", "key"), "y", trees=10, depth=6)
    rows, told = seen[-1]
    assert told.count() < rows.count() / 2 and [*forest.cuts] == ["b"] and len(forest.cuts["b"]) <= 31
    sums = lambda t, w: t.selectExpr(f"sum({w})", f"sum({w} * _label)", f"sum({w} * _label * _label)").first()
    assert [*sums(told, "_weight")] == pytest.approx([*sums(rows, "1")])
    with monkeypatch.context() as patch:
        patch.setattr(model, "CELL_ROWS", 1 << 40)
        plain = model.train_forest(df.drop("kind", "key"), "y", trees=10, depth=6)
    assert seen[-1][1] is None and not plain.counted
    assert forest.metrics().first().rmse == pytest.approx(plain.metrics().first().rmse, rel=0.25)
    assert forest.tree_importance().first().feature == plain.tree_importance().first().feature == "a"
    at_once = {r.feature: r.importance for r in forest.permutation_importance().collect()}
    forest.counted = False
    one_by_one = {r.feature: r.importance for r in forest.permutation_importance().collect()}
    assert at_once == pytest.approx(one_by_one, abs=1e-9) and max(at_once, key=at_once.get) == "a"
    scored = forest.score(df.limit(100).drop("y"))
    assert scored.count() == 100 and "b" in scored.columns and scored.where("y_prediction is null").count() == 0

    forest = model.train_forest(df.drop("y", "key"), "kind", trees=5, depth=4)
    rows, told = seen[-1]
    assert told.count() < rows.count() / 2 and told.agg(F.sum("_weight")).first()[0] == rows.count()
    assert forest.metrics().first().accuracy > 0.99
    at_once = forest.permutation_importance().collect()
    forest.counted = False
    assert at_once == forest.permutation_importance().collect() and at_once[0].feature == "a"
    model.train_forest(df.drop("kind"), "y", trees=2, depth=2)  # the key has too many values with the others
    assert seen[-1][1] is None


def test_any_number_of_classes(spark):
    df = spark.range(3000).selectExpr(
        "id % 150 div 15 as a", "id % 15 as b", "timestamp_seconds(id) as at", "concat('class ', id % 150) as kind"
    )  # fewer values per feature than a tree has bins; the time is no feature, but keeps equal rows apart in the split
    forest = model.train_forest(df, "kind", trees=10, depth=10)
    scored = forest.score(df)
    assert scored.columns == ["a", "b", "at", "kind", "kind_prediction"] and scored.count() == 3000
    assert {r[0] for r in scored.select("kind_prediction").distinct().collect()} <= {f"class {i}" for i in range(150)}
    assert forest.metrics().first().accuracy > 0.3
    with pytest.raises(ValueError, match="more than 100 classes"):
        model.train_forest(df, "kind", trees=1, class_limit=100)


def test_nothing_is_collected_per_class(spark):
    df = spark.range(600).selectExpr("id % 30 as a", "concat('class ', id % 30) as kind")
    plan = model.train_forest(df, "kind", trees=2, depth=3).score(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "class 29" not in plan


def test_one_row_group_is_dealt_out_for_training_and_scoring(spark):
    lines = table(spark, DATA, "lineitem").withColumn("late", F.expr("l_linenumber > 3"))
    scored = model.train_forest(lines, "late", trees=5, depth=3).score(lines)
    assert scored.rdd.getNumPartitions() > table(spark, DATA, "lineitem").rdd.getNumPartitions()
    assert scored.where("late <> late_prediction").count() == 0
    assert scored.drop("late_prediction").exceptAll(lines).count() == 0 and scored.count() == lines.count()


@pytest.fixture(scope="module")
def trained(spark):
    """A forest, and a holdout that holds one row a hundred times."""
    rows = [(float(i % 13), float(i % 7), float(i % 3), float(i % 13 * 10 + i % 7)) for i in range(400)]
    forest = model.train_forest(spark.createDataFrame(rows, "a double, b double, c double, y double"), "y", trees=5, depth=6)
    forest.holdout = spark.createDataFrame(rows[:120] + [rows[5]] * 100, "a double, b double, c double, y double")
    return forest


def test_vectors_of_a_large_split_are_kept_in_small_parts(spark, monkeypatch):
    """One task's vectors come from a bounded stretch of a file, whatever the session's splits are."""
    path = scratch_path(spark, "groups")
    rows = spark.range(200_000).selectExpr("xxhash64(id) as a", "id % 7 as b", "id * 0.5 as y").coalesce(1)
    rows.write.option("parquet.block.size", 200_000).option("parquet.page.size", 20_000).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    kept, cells = [], model._cells
    monkeypatch.setattr(model, "VECTOR_SPLIT", 100_000)
    monkeypatch.setattr(model, "spread_once", lambda df: df)
    monkeypatch.setattr(model, "_cells", lambda forest, rows: kept.append(rows) or cells(forest, rows))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        model.train_forest(spark.read.parquet(path), "y", trees=2, depth=2)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    parts = [r[0] for r in kept[0].groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(parts) > 150_000 and max(parts) < 30_000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_importance_is_the_same_on_any_partitions(spark, trained):
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (4, 200):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        held, trained.holdout = trained.holdout, trained.holdout.repartition(parts)
        found.append({r.feature: r.importance for r in trained.permutation_importance().collect()})
        trained.holdout = held
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == pytest.approx(found[1], abs=1e-9)
    assert found[0]["a"] > 10 and found[0]["a"] > 5 * found[0]["b"] > 0


def test_importance_like_brute_force(spark, trained):
    rows = trained.vectors(trained.holdout).select(vector_to_array("_features").alias("x"), F.col("y").alias("_label"))
    pairs = with_partners(rows, ["x"], 42).collect()
    assert sorted(p.x for p in pairs) == sorted(p.other_x for p in pairs) == sorted(r.x for r in rows.collect())

    def rmse(vectors):
        guess = [trained.model.predict(Vectors.dense(v)) for v in vectors]
        return math.sqrt(sum((g - p._label) ** 2 for g, p in zip(guess, pairs, strict=True)) / len(pairs))

    base = rmse([p.x for p in pairs])
    want = {f: rmse([[*p.x[:i], p.other_x[i], *p.x[i + 1 :]] for p in pairs]) - base for i, f in enumerate("abc")}
    assert {r.feature: r.importance for r in trained.permutation_importance().collect()} == pytest.approx(want)


def test_partners_come_from_anywhere(spark):
    df = spark.range(5000).select((F.col("id") * 3 % 5000).alias("v"), F.lit("same").alias("s"))
    got = with_partners(df, ["v"]).collect()
    assert sorted(r.other_v for r in got) == [*range(5000)]
    assert 1500 < sum(abs(r.v - r.other_v) for r in got) / 5000 < 1840  # a third of the range
    again = with_partners(df.repartition(3), ["v"]).collect()
    assert {(r.v, r.other_v) for r in got} == {(r.v, r.other_v) for r in again}
    assert {(r.v, r.other_v) for r in got} != {(r.v, r.other_v) for r in with_partners(df, ["v"], seed=7).collect()}


def test_copies_are_told_apart(spark):
    df = spark.range(25_003).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.lit(None).cast("int").alias("n"))
    apart = told_apart(df)
    assert apart.distinct().count() == apart.count() == 25_003
    assert apart.where("k = 'hot'").agg(F.min("_copy"), F.max("_copy"), F.count_distinct("_copy")).first()[:] == (0, 16_667, 16_668)
    order, n = ranked(apart, [F.xxhash64("k", "_copy"), "k", "_copy"])
    assert n == 25_003 and order.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()[:] == (0, 25_002, 25_003)
    assert ranked(apart.limit(0), ["k"])[0].count() == 0


def test_unseen_levels_and_gaps(spark, learnable, frame):
    prep = model.fit_preparation(learnable, "answer")
    new = frame("colour string, noise double, still double", ("pink", None, None))
    row = prep.transform(new).first()
    assert None not in tuple(row)
    assert prep.moments["still"][1] == 0


def test_split_does_not_depend_on_partitioning(spark):
    df = table(spark, DATA, "lineitem")
    sizes = [model.split_by_hash(df.repartition(n))[0].count() for n in (1, 6)]
    assert sizes[0] == sizes[1]
    assert abs(sizes[0] / df.count() - 0.8) < 0.03


def test_zero_division_in_metrics(frame):
    scored = frame("l string, p string", ("a", "b"), ("a", "b"))
    assert tuple(model.classification_metrics(scored, "l", "p").first()) == (0.0, 0.0)


def _land(spark):
    events = table(spark, DATA, "events")
    folder = scratch_path(spark, "landing")
    events.repartition(3).write.parquet(folder)
    return events, folder


def test_stream_equals_batch(spark):
    events, folder = _land(spark)
    plan = fit(events, CleanerConfig(dedupe=False))
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    for _ in range(2):  # the second run finds nothing new
        stream = clean_stream(read_landing(spark, folder, plan), plan)
        write_landing(stream, out, state).awaitTermination()
    got, want = spark.read.parquet(out), plan.transform(events)
    assert got.count() == want.count() == events.count()
    assert got.exceptAll(want.select(got.columns)).count() == 0


def test_stream_drops_copies_by_key(spark):
    events, folder = _land(spark)
    events.write.mode("append").parquet(folder)
    plan = fit(events, CleanerConfig(winsorize_exclude_ids=True))
    stream = clean_stream(
        read_landing(spark, folder, plan), plan, ["event_id"], "ts", "400 days"
    )
    out = scratch_path(spark, "out")
    write_landing(stream, out).awaitTermination()
    assert spark.read.parquet(out).count() == events.count()
    with pytest.raises(ValueError, match="event_time"):
        clean_stream(read_landing(spark, folder, plan), plan, ["event_id"])


def _keyed(spark, batches, keys, order, late_by, keep_ms, schema="k string, ts timestamp, v double, s string"):
    """Each batch is a run that goes on from the checkpoint; what the stream has told after each."""
    landing, out, state = (scratch_path(spark, x) for x in ("landing", "first", "state"))
    told = []
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(landing)
        with keyed.keyed_state(spark):
            stream = spark.readStream.schema(df.schema).parquet(landing)
            query = keyed.write_keyed(keyed.first_by_key(stream, keys, order, "ts", late_by, keep_ms), out, state)
            query.awaitTermination()
        told.append((keyed.keyed_table(spark, out, state, df.schema).collect(), keyed.step_counts(query)))
    return told


def test_keyed_stream_in_any_order_equals_batch(spark):
    pick = random.Random(4)
    rows = []
    for i in range(300):
        at = datetime(2024, 1, 1) + timedelta(minutes=pick.randrange(10_000))
        value = pick.choice([None, math.nan, 1.0, 2.0, -3.5, float(i)])
        rows.append((pick.choice(["a", "b", None, *"cdefgh"]), at, value, pick.choice([None, "x", "y", "é"])))
    rows += rows[:40]
    pick.shuffle(rows)
    told = _keyed(spark, [rows[:120], rows[120:200], rows[200:]], ["k"], ["v", "s"], "30 days", 1000)
    frame = spark.createDataFrame(rows, "k string, ts timestamp, v double, s string")
    want = dedupe_rows(frame, ["k"], ["v", "s"]).collect()
    assert sorted(map(str, [r[:4] for r in told[-1][0]])) == sorted(map(str, [r[:] for r in want]))
    assert not any(r.late for r in told[-1][0])
    assert told[-1][1]["read"] == 140 and told[-1][1]["held"] >= 9


def test_keyed_stream_expiry_and_late_rows(spark):
    day = lambda n: datetime(2024, 1, n)
    batches = [
        [("a", day(1), 5.0, "x"), ("a", day(2), 4.0, "y"), ("b", day(20), 1.0, "z"), ("n", None, 0.0, "undated")],
        [("a", day(3), 1.0, "late"), ("b", day(19), 0.5, "earlier"), ("a", day(21), 9.0, "again")],
    ]
    told = _keyed(spark, batches, ["k"], ["v"], "5 days", 86_400_000)
    assert {(r.k, r.s, r.late) for r in told[0][0]} == {("a", "y", False), ("b", "z", False), ("n", "undated", True)}
    assert {(r.k, r.s, r.late) for r in told[1][0]} == {
        ("a", "y", False), ("b", "earlier", False), ("n", "undated", True), ("a", "late", True), ("a", "again", False),
    }


def test_keyed_stream_refuses_what_it_cannot_do(spark):
    folder, schema = scratch_path(spark, "none"), "k string, ts timestamp, m map<string,int>"
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    with pytest.raises(ValueError, match="keyed_state"):
        keyed.first_by_key(stream, ["k"], [], "ts")
    with keyed.keyed_state(spark), pytest.raises(ValueError, match="ordered by 'm'"):
        keyed.first_by_key(stream, ["k"], [], "ts")


def test_keys_that_share_an_entry_of_the_state(spark, monkeypatch):
    """Keys in one entry keep their own first rows and their own ends; fewer entries than keys are held."""
    from functools import partial

    day = lambda n: datetime(2024, 1, n)
    batches = [
        [(k, day(n), float(n), s) for k, n, s in [("a", 1, "a"), ("b", 2, "b"), (None, 3, "none"), ("c", 9, "c"), ("c", 10, "c2")]],
        [("c", day(11), 1.0, "first"), ("b", day(4), 1.0, "late"), ("a", day(30), 0.0, "again")],
    ]
    monkeypatch.setattr(keyed, "first_by_key", partial(keyed.first_by_key, slots=1))
    told = _keyed(spark, batches, ["k"], ["v"], "5 days", 86_400_000)
    assert {(r.k, r.s, r.late) for r in told[0][0]} == {("a", "a", False), ("b", "b", False), (None, "none", False), ("c", "c", False)}
    assert told[0][1]["held"] < 4
    closed = {("a", "a", False), ("b", "b", False), (None, "none", False), ("b", "late", True), ("c", "first", False)}
    assert {(r.k, r.s, r.late) for r in told[1][0]} == {*closed, ("a", "again", False)}


def test_each_bag_of_few_cells_holds_all_of_them(spark):
    """A value that is in one cell alone must not be missing from a third of the trees."""
    df = spark.range(6_000).selectExpr("cast(id % 25 as double) as grade", "timestamp_seconds(id) as at", "(id % 25 * 37 % 101) * 1.5 as fee")
    forest = model.train_forest(df, "fee", trees=10, depth=20)
    assert forest.counted
    assert forest.score(df).where("abs(fee - fee_prediction) > 1e-6").count() == 0
