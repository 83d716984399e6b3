"""Fitting and applying cleaning plans; known quirks in both modes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.plans import fit as fitting
from millrace.plans.cleaning import CleaningPlan, enforce_schema
from millrace.plans.config import CleanerConfig
from millrace.plans.fit import clean, fit
from queries.base import dirty_orders, table
from tests.conftest import DATA

QUIET = {
    "winsorize_lower_q": None,
    "winsorize_upper_q": None,
    "mark_outliers_zscore": False,
    "impute_categorical": False,
    "dedupe": False,
}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_parity_and_storage(spark):
    df = dirty_orders(spark, DATA)
    plan = fit(df)
    cleaned, report = clean(df)
    again = CleaningPlan.from_json(plan.to_json())
    assert again.to_json() == plan.to_json()
    assert rows_of(again.transform(df)) == rows_of(cleaned)
    steps = [r.step for r in report.collect()]
    assert len(steps) == 30 and steps[0] == "normalize_column_names"


def test_partitioning_does_not_matter(spark):
    df = dirty_orders(spark, DATA)
    one, many = fit(df.coalesce(1)), fit(df.repartition(11))
    assert one.bounds == many.bounds and one.medians == many.medians
    assert one.readings == many.readings and one.parts == many.parts
    for c in one.moments:
        assert one.moments[c] == pytest.approx(many.moments[c])


def test_null_never_becomes_text(spark):
    df = dirty_orders(spark, DATA)
    out = fit(df, CleanerConfig(**QUIET)).transform(df)
    texts = [f.name for f in out.schema.fields if f.dataType.simpleString() == "string"]
    for c in texts:
        assert out.where(F.lower(c).isin("nan", "none", "null")).count() == 0
    assert out.count() == df.count()
    assert out.where("status_raw is null").count() > 0


def test_imputed_and_unique(spark):
    out, _ = clean(dirty_orders(spark, DATA))
    for c in ("status_raw", "price", "compound_part1"):
        assert out.where(F.col(c).isNull()).count() == 0


def test_guarded_and_trusting_mode_for_dates(frame):
    df = frame("k int, p string", *[(i, f"${i}.50") for i in range(20)])
    guarded = fit(df, CleanerConfig(**QUIET))
    assert guarded.readings["p"].kind == "amount"
    trusting = fit(df, CleanerConfig(min_parse_ratio=0, **QUIET))
    assert trusting.readings["p"].kind == "time"
    assert trusting.transform(df).where("p is not null").count() == 0


def test_guarded_and_trusting_mode_for_versions(frame):
    df = frame("k int, v string", *[(i, f"1.{i}.3") for i in range(20)])
    assert "v" not in fit(df, CleanerConfig(**QUIET)).readings
    assert fit(df, CleanerConfig(min_parse_ratio=0, **QUIET)).readings["v"].kind == "number"


def test_priorities_stay_text(spark):
    df = table(spark, DATA, "orders").select("o_orderkey", "o_orderpriority")
    assert fit(df, CleanerConfig(**QUIET)).readings == {}


def test_long_texts_can_be_kept_whole(spark):
    df = table(spark, DATA, "documents").select("doc_id", "text")
    assert fit(df, CleanerConfig(**QUIET)).parts == {"text": 6}
    assert fit(df, CleanerConfig(split_max_avg_len=200, **QUIET)).parts == {}


def test_compound_has_at_most_six_parts(frame):
    df = frame("k int, c string", (1, "a|b|c|d|e|f|g"), (2, "x;y"), (3, None), (4, "p - q"))
    out = fit(df, CleanerConfig(**QUIET)).transform(df).orderBy("k").collect()
    assert out[0].c_part6 == "f|g"
    assert (out[1].c_part1, out[1].c_part2, out[1].c_part3) == ("x", "y", None)
    assert out[2].c_part1 is None and (out[3].c_part1, out[3].c_part2) == ("p", "q")


def test_json_fields(frame):
    docs = [
        '{"a": 1, "b": {"c": "X", "d.e": 1.5}, "l": [1, 2]}',
        '{"a": "two", "b": {"c": "Y"}}',
        '{"a": null, "b": {}}',
        "{broken}",
    ]
    df = frame("k int, j string", *enumerate(docs))
    config = CleanerConfig(split_delimiters=("|",), **QUIET)
    out = fit(df, config).transform(df)
    assert sorted(out.columns) == ["j__a", "j__b.c", "j__b.d.e", "j__l", "j__rest", "k"]
    got = {r.k: r for r in out.collect()}
    assert got[0]["j__a"] == "1" and got[1]["j__a"] == "two" and got[2]["j__a"] is None
    assert got[0]["j__b.c"] == "X"  # case is kept inside JSON
    assert got[0]["j__b.d.e"] == 1.5 and got[0]["j__l"] == "[1,2]"
    assert got[3]["j__a"] is None and got[3]["j__rest"] == "{broken}"
    assert all(got[k]["j__rest"] is None for k in range(3))


def test_json_that_no_field_holds_is_kept(frame):
    docs = ['{"a": 1, "b": {"c": 2}, "ID": 1, "id": 2}', '{"a": 3, "b": {"c": 4}}']
    plan = fit(frame("k int, j string", *enumerate(docs)), CleanerConfig(split_delimiters=("|",), **QUIET))
    odd = [
        '{"a": 1, "new": 2}', '{"b": {"c": 1, "d": 2}}', '{"a": "text"}', '{"b": 7}', "[0, 9]", "17",
        '{"a": null, "b": {"c": 5}}', """{"it's \\"so\\"": 1}""",
    ]
    out = {r.k: r for r in plan.transform(frame("k int, j string", *enumerate(odd))).collect()}
    kept = {k for k, r in out.items() if r["j__rest"] is not None}
    assert kept == {0, 1, 2, 3, 4, 5, 7} and all(out[k]["j__rest"] == odd[k] for k in kept)
    same = {r.k: r for r in plan.transform(frame("k int, j string", *enumerate(docs))).collect()}
    assert (same[0]["j__ID"], same[0]["j__id_2"], same[0]["j__rest"]) == (1, 2, None)


def test_later_batches_lose_nothing(frame):
    plan = fit(frame("k int, c string", (1, "a|b"), (2, "x|y")), CleanerConfig(**QUIET))
    (later,) = plan.transform(frame("k int, c string", (3, "a|b|c|d"))).collect()
    assert (later.c_part1, later.c_part2) == ("a", "b|c|d")


def test_too_many_json_fields_stay_text(spark):
    doc = F.concat(F.lit('{"k'), F.col("id").cast("string"), F.lit('": 1}'))
    df = spark.range(50).select("id", doc.alias("j"))
    plan = fit(df, CleanerConfig(split_delimiters=("|",), **QUIET))
    assert plan.json_fields == {} and "j" in plan.transform(df).columns
    wider = fit(df, CleanerConfig(json_max_expand_cols=50, split_delimiters=("|",), **QUIET))
    assert len(wider.json_fields["j"]) == 50


def test_number_companions_do_not_overwrite(frame):
    df = frame("k int, t string, t_num string", *[(i, f"no {i}", f"q{i}") for i in range(9)])
    out = fit(df, CleanerConfig(**QUIET)).transform(df)
    assert "t_num_num" in out.columns and out.schema["t_num"].dataType.simpleString() == "string"


def test_small_and_empty_tables(frame):
    one = frame("a int, b string", (1, "x"))
    plan = fit(one)
    assert plan.constant == [] and "drop_constant_columns" in plan.skipped
    assert rows_of(plan.transform(one).select("a", "b")) == [(1.0, "x")]
    empty = one.limit(0)
    assert fit(empty).transform(empty).count() == 0
    nulls = frame("a int, b string", (None, None), (None, None), (1, "x"))
    assert fit(nulls).transform(nulls).count() == 1


def test_constant_and_nan_columns(frame):
    nan = float("nan")
    rows = [(i, 7, nan, "q" if i else None, 1.0 * (i % 2)) for i in range(10)]
    df = frame("k int, seven int, hole double, almost string, flip double", *rows)
    plan = fit(df, CleanerConfig(**QUIET))
    assert plan.constant == ["seven", "hole"]
    assert "almost" in plan.kept


def test_colliding_names(frame):
    df = frame("`a b` int, `a-b` int, `a.b` int", (1, 2, 3), (4, 5, 6))
    out = fit(df, CleanerConfig(**QUIET)).transform(df)
    assert out.columns == ["a_b", "a_b_2", "a_b_3"]


def test_user_steps(spark):
    df = table(spark, DATA, "part").select("p_partkey", "p_brand")
    good = ("double_key", lambda d, plan: d.withColumn("twice", F.col("p_partkey") * 2))
    bad = ("broken", lambda d, plan: d.select("nope"))
    out, report = clean(df, CleanerConfig(**QUIET), [good, bad])
    state = {r.step: r for r in report.collect()}
    assert "twice" in out.columns
    assert state["broken"].skipped and "nope" in state["broken"].reason
    assert state["double_key"].cols_after == state["double_key"].cols_before + 1


def test_mode_and_approximate_fit(spark):
    df = dirty_orders(spark, DATA)
    plan = fit(df, CleanerConfig(categorical_strategy="mode", approx=True))
    assert plan.fills["status_raw"] in ("f x", "o x", "p x", "n/a")
    exact = fit(df)
    low, high = plan.bounds["price"]
    assert low == pytest.approx(exact.bounds["price"][0], rel=0.2)
    assert high == pytest.approx(exact.bounds["price"][1], rel=0.05)


def test_limits_in_any_combination(frame):
    df = frame("k int, x double", *[(i, float(i - 5)) for i in range(11)], (11, None))
    config = CleanerConfig(
        clip_numeric_max=3.0, positive_only_columns=("x",), **{**QUIET, "dedupe": False}
    )
    out = sorted(r.x for r in fit(df, config).transform(df).collect())
    # -5 … 5 limited to 0 … 3; the gap gets the median of the limited values
    assert out == [0.0] * 7 + [1.0, 2.0, 3.0, 3.0, 3.0]


def test_categories_keep_their_codes(spark, frame, monkeypatch):
    config = CleanerConfig(enforce_schema={"c": "category", "k": "int"}, **QUIET)
    df = frame("k string, c string", ("1", "b"), ("2", "a"), ("3", "c"))
    plan = fit(df, config)
    later = frame("k string, c string", ("9", "c"), ("8", "zzz"))
    assert rows_of(plan.transform(later)) == [(8, 3), (9, 2)]
    monkeypatch.setattr(fitting, "LEVELS_IN_PLAN", 1)
    stored = fit(df, config)
    assert "path" in stored.levels["c"]
    assert rows_of(stored.transform(later)) == [(8, 3), (9, 2)]


def test_wrong_options(frame):
    df = frame("a int", (1,))
    with pytest.raises(ValueError, match="unknown type"):
        fit(df, CleanerConfig(enforce_schema={"a": "decimal"}))
    with pytest.raises(ValueError, match="unknown type"):
        enforce_schema(df, {"a": "money"})
    with pytest.raises(ValueError, match="missing"):
        fit(df).transform(df.withColumnRenamed("a", "z"))


def test_many_renamed_columns(spark):
    """Planning time must not grow exponentially with the number of columns."""
    numbers = [(F.rand(i) * 100).alias(f"N {i}") for i in range(40)]
    texts = [F.concat(F.lit("v "), F.col("id") % (i + 2)).alias(f"S {i}") for i in range(10)]
    df = spark.range(300).select("id", *numbers, *texts)
    plan = fit(df)
    out = plan.transform(df)
    assert out.count() == 300 and len(plan.bounds) == 51


def test_numeric_passes_read_only_their_columns(spark, tmp_path):
    """Beyond the first pass no scan reads a column it does not aggregate."""
    path = f"{tmp_path}/t"
    spark.range(300).select(
        "id", (F.col("id") % 50).cast("double").alias("x"), F.concat(F.lit("text "), F.col("id") % 9).alias("t")
    ).write.parquet(path)
    df = spark.read.parquet(path)
    plan = fit(df, CleanerConfig(**QUIET))
    stage = plan.transform(df, until="limit_numeric", skip=("drop_empty_rows",)).agg(F.avg("x"))
    schema = stage._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert "x:double" in schema and "t:string" not in schema and "id:" not in schema


def test_empty_rows_do_not_count(frame):
    rows = [(float(i), f"v{i % 2}") for i in range(9)] + [(None, "v0"), (None, None), (None, None)]
    config = CleanerConfig(mark_outliers_zscore=True, dedupe=False, enforce_schema={"t": "category"}, drop_constant_columns=False)
    with_empty, without = (fit(frame("x double, t string", *r), config) for r in (rows, rows[:10]))
    assert with_empty.medians == without.medians and with_empty.moments.keys() == without.moments.keys()
    assert all(with_empty.moments[c] == pytest.approx(m) for c, m in without.moments.items())
    assert with_empty.levels == without.levels and with_empty.fills == without.fills


def test_later_columns_and_failed_casts_are_kept(spark):
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    plan = fit(frame("k int, n bigint", (0, None), (1, 10), (2, 20), (3, 30)), CleanerConfig(**{**QUIET, "dedupe": True}))
    schema = "k int, n string, `New One` string, n_id double"
    later = frame(schema, (4, "40", " As It Is ", 1.5), (5, "oops", None, None), (6, None, "a", None), (6, None, "b", None))
    out = plan.transform(later)
    assert out.columns == ["n_id", "k", "n", "n__rest", "new_one"]
    assert rows_of(out) == sorted(
        [(1.5, 4, 40.0, None, " As It Is "), (None, 5, 20.0, "oops", None), (None, 6, 20.0, None, "a"), (None, 6, 20.0, None, "b")],
        key=repr,
    )
    halves = plan.transform(frame("k int, n double", (7, 70.0), (8, 80.5), (9, float("nan"))))
    assert sorted((r.k, r.n__rest) for r in halves.collect()) == [(7, None), (8, "80.5"), (9, None)]
    assert plan.transform(frame("k int, n int", (7, 70))).columns == ["k", "n"]


def test_numbers_from_text_are_read_once_on_large_tables(spark, monkeypatch):
    plain = spark.range(60).selectExpr(
        "id as o_id", "concat('$', cast(id * 3 % 17 as string), '.50') as price", "case when id % 7 > 0 then concat('{\"a\": {\"b.c\": ', id, '}, \"A\": 1.5}') end as doc"
    )
    before = fit(plain)
    monkeypatch.setattr(fitting, "NUMBERS_ROWS", 10)
    seen = []
    for name in ("order_statistics", "moments"):
        own = getattr(fitting, name)
        monkeypatch.setattr(fitting, name, lambda df, *a, own=own, **b: (seen.append(df), own(df, *a, **b))[1])
    after = fit(plain)
    assert after.readings and after.json_fields and (after.bounds, after.medians) == (before.bounds, before.medians)
    assert {c: pytest.approx(m) for c, m in before.moments.items()} == after.moments  # sums of doubles differ by their order
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in seen]
    assert len(plans) == 2 and not any("Range (0" in p for p in plans)
