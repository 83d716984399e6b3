"""Profiles, distributions and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import compare, frequency, heavy, profile, state
from millrace.session import scratch_path
from queries.base import DIRTY_DUCK, DUP_DUCK, SPARSE_DUCK, dirty_orders, dup_events
from queries.base import sparse_orders, table

LINE_NUMBERS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax"
).split()
LINE_OTHERS = "l_returnflag l_linestatus l_shipdate".split()
TYPES = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}
STATS = ("mean", "std", "min", "max")


def _rounded(df, digits: int = 4):
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def profile_columns(spark, d):
    return _rounded(profile.profile_columns(table(spark, d, "lineitem")))


def profile_dirty(spark, d):
    """A table with NULLs and text columns."""
    return _rounded(profile.profile_columns(dirty_orders(spark, d), ["status_raw", "price"]))


def outlier_counts(spark, d):
    return profile.outlier_counts(table(spark, d, "events"), ["value", "user_id"])


def top_values(spark, d):
    df = table(spark, d, "lineitem")
    return frequency.top_values(df, ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"], 5)


WIDE = ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate", "l_returnflag"]


def top_values_exact(spark, d):
    """The same from candidates: only values that could be among the best are counted and shuffled."""
    return heavy.frequent_values(table(spark, d, "lineitem"), WIDE, 5)


def profile_batches(spark, d):
    """Lineitem in four batches, each kept as state and then merged; no row is read again for the profile."""
    lines = table(spark, d, "lineitem")
    path = scratch_path(spark, "state")
    for i in range(4):
        state.add_batch(lines.where(F.col("l_orderkey") % 4 == i), path, f"b{i}")
    found = state.profile(spark, path)
    true = frequency.distinct_counts(lines, lines.columns).withColumnRenamed("n_distinct", "true_distinct")
    near = F.abs(F.col("n_distinct") - F.col("true_distinct")) <= state.HLL_ERROR * F.col("true_distinct") + 1
    joined = found.join(true, "column_name").withColumn("distinct_near", near)
    kept = ("column_name", "n_rows", "n_null", "count", "mean", "std", "min", "max", "distinct_near")
    return _rounded(joined.select(*kept), 2)


def frequent_texts(spark, d):
    return frequency.top_values(dirty_orders(spark, d), ["status_raw", "compound", "flag"], 3)


def distinct_counts(spark, d):
    return frequency.distinct_counts(table(spark, d, "lineitem"), LINE_NUMBERS + LINE_OTHERS)


def null_summary(spark, d):
    out = profile.null_summary(dirty_orders(spark, d))
    return out.select("column_name", "n_rows", "n_null")


def high_null(spark, d):
    df = dirty_orders(spark, d).withColumn(
        "rare", F.when(F.col("o_orderkey") % 3 == 0, F.col("price"))
    )
    return _rounded(profile.high_null_columns(df), 6)


def high_cardinality(spark, d):
    return _rounded(profile.high_cardinality_columns(table(spark, d, "events")), 6)


def describe(spark, d):
    return _rounded(profile.describe(table(spark, d, "lineitem")))


def correlation(spark, d):
    df = table(spark, d, "lineitem").select(*LINE_NUMBERS)
    return _rounded(profile.correlation(df), 6)


def correlation_with_nulls(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "price", F.lit(5).alias("constant"))
    return _rounded(profile.correlation(df), 6)


def data_bytes(spark, d):
    return profile.data_bytes(table(spark, d, "documents"))


def duplicate_count(spark, d):
    return frequency.duplicate_count(dup_events(spark, d))


def cleaning_report(spark, d):
    out = profile.cleaning_report(dup_events(spark, d))
    return out.select("column_name", "n_rows", "n_null", "duplicate_rows")


def _halves(spark, d):
    orders = table(spark, d, "orders")
    pivot = F.lit("1996-01-01").cast("timestamp_ntz")
    early = orders.where(F.col("o_orderdate") < pivot)
    late = orders.where(F.col("o_orderdate") >= pivot)
    late = late.withColumnRenamed("o_orderpriority", "priority")
    return early, late.withColumn("o_custkey", F.col("o_custkey").cast("string"))


def compare_schema(spark, d):
    return compare.compare_schema(*_halves(spark, d))


def compare_shape(spark, d):
    out = compare.compare_shape(*_halves(spark, d))
    return out.withColumn("n_columns", F.col("n_columns").cast("bigint"))


def numeric_drift(spark, d):
    return _rounded(compare.numeric_drift(*_halves(spark, d)))


def sparse_profile(spark, d):
    """Null shares after empty rows are gone."""
    from millrace.operators.names import normalize_column_names
    from millrace.operators.rows import drop_empty_rows

    df = drop_empty_rows(normalize_column_names(sparse_orders(spark, d)))
    out = profile.null_summary(df).where(F.col("column_name").isin("order_key", "status", "half_null"))
    return out.select("column_name", "n_rows", "n_null")


QUERIES = {
    f.__name__: f
    for f in (
        profile_columns,
        profile_dirty,
        outlier_counts,
        top_values,
        top_values_exact,
        profile_batches,
        frequent_texts,
        distinct_counts,
        null_summary,
        high_null,
        high_cardinality,
        describe,
        correlation,
        correlation_with_nulls,
        data_bytes,
        duplicate_count,
        cleaning_report,
        compare_schema,
        compare_shape,
        numeric_drift,
        sparse_profile,
    )
}


def _union(parts) -> str:
    return "\nunion all\n".join(parts)


def _profile_sql(column: str, kind: str, source: str, numeric: bool) -> str:
    shares = f"""'{column}' as column_name, '{kind}' as inferred_type,
      round(100.0::double * count(*) filter (where {column} is null) / count(*), 2) as null_percent,
      round(100.0::double * count(distinct {column}) / count({column}), 2) as unique_percent"""
    if not numeric:
        return f"""select {shares}, null::double as mean, null::double as std, null::double as min,
      null::double as max, null::bigint as outlier_count from {source}"""
    return f"""select {shares}, round(avg({column}), 4) as mean, round(stddev_samp({column}), 4) as std,
      round(min({column})::double, 4) as min, round(max({column})::double, 4) as max,
      count(*) filter (where abs({column} - m) > 3 * s) as outlier_count
      from {source} t, (select avg({column}) as m, stddev_pop({column}) as s from {source}) z"""


def _top_sql(column: str, source: str, k: int) -> str:
    return f"""select * from (select '{column}' as column_name, cast({column} as varchar) as value,
      count(*) as n, row_number() over (order by count(*) desc, {column}) as rank
      from {source} where {column} is not null group by {column}) where rank <= {k}"""


def _null_sql(column: str, source: str) -> str:
    return f"""select '{column}' as column_name, count(*) as n_rows,
      count(*) filter (where {column} is null) as n_null from {source}"""


def _describe_number(c: str) -> str:
    return f"""select '{c}' as column_name, count({c}) as count, null::bigint as "unique",
      null::varchar as top, null::bigint as freq, round(avg({c}), 4) as mean,
      round(stddev_samp({c}), 4) as std, round(min({c})::double, 4) as min,
      round(quantile_cont({c}::double, 0.25), 4) as p25, round(quantile_cont({c}::double, 0.5), 4) as p50,
      round(quantile_cont({c}::double, 0.75), 4) as p75, round(max({c})::double, 4) as max
      from lineitem"""


def _describe_other(c: str) -> str:
    top = f"select {c} as v, count(*) as n from lineitem group by 1 order by 2 desc, 1 limit 1"
    return f"""select '{c}' as column_name, count({c}) as count, count(distinct {c}) as "unique",
      (select cast(v as varchar) from ({top})) as top, (select n from ({top})) as freq,
      null::double as mean, null::double as std, null::double as min, null::double as p25,
      null::double as p50, null::double as p75, null::double as max from lineitem"""


def _corr_sql(columns, source: str) -> str:
    return _union(
        f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as corr from {source}"
        for a in columns
        for b in columns
    )


_EARLY = "(select * from orders where o_orderdate < timestamp '1996-01-01')"
_LATE = "(select * from orders where o_orderdate >= timestamp '1996-01-01')"


def _drift_sql(c: str) -> str:
    def side(source: str, n: int) -> str:
        return f"""(select round(avg({c}), 4) as mean_{n}, round(stddev_samp({c}), 4) as std_{n},
          round(min({c})::double, 4) as min_{n}, round(max({c})::double, 4) as max_{n} from {source})"""

    return f"select '{c}' as column_name, * from {side(_EARLY, 1)} a, {side(_LATE, 2)} b"


_DIRTY_COLUMNS = "o_orderkey status_raw price_usd pct flag compound price".split()
_EVENT_COLUMNS = "event_id ts user_id event_type value props".split()

ORACLES = {
    "profile_columns": _union(
        _profile_sql(c, TYPES.get(c, "double"), "lineitem", c in LINE_NUMBERS)
        for c in LINE_NUMBERS + LINE_OTHERS
    ),
    "profile_dirty": _union(
        [
            _profile_sql("status_raw", "string", DIRTY_DUCK, False),
            _profile_sql("price", "double", DIRTY_DUCK, True),
        ]
    ),
    "outlier_counts": _union(
        f"""select '{c}' as column_name, count(*) filter (where abs({c} - m) > 3 * s) as outlier_count
        from events, (select avg({c}) as m, stddev_pop({c}) as s from events)"""
        for c in ("value", "user_id")
    ),
    "top_values": _union(
        _top_sql(c, "lineitem", 5)
        for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    ),
    "top_values_exact": _union(_top_sql(c, "lineitem", 5) for c in WIDE),
    "profile_batches": _union(
        f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, "
        + (
            f"count({c}) as count, round(avg({c}), 2) as mean, round(stddev_samp({c}), 2) as std, "
            f"round(min({c})::double, 2) as min, round(max({c})::double, 2) as max"
            if c in LINE_NUMBERS
            else "0 as count, null::double as mean, null::double as std, null::double as min, null::double as max"
        )
        + ", true as distinct_near from lineitem"
        for c in LINE_NUMBERS + LINE_OTHERS
    ),
    "frequent_texts": _union(
        _top_sql(c, DIRTY_DUCK, 3) for c in ("status_raw", "compound", "flag")
    ),
    "distinct_counts": _union(
        f"select '{c}' as column_name, count(distinct {c}) as n_distinct from lineitem"
        for c in LINE_NUMBERS + LINE_OTHERS
    ),
    "null_summary": _union(_null_sql(c, DIRTY_DUCK) for c in _DIRTY_COLUMNS),
    "high_null": """select 'rare' as column_name, round(avg(case when o_orderkey % 3 = 0
        and o_orderkey % 13 <> 0 then 0.0::double else 1.0 end), 6) as null_ratio from orders""",
    "high_cardinality": "select * from ("
    + _union(
        f"""select '{c}' as column_name, count(distinct {c}) as n_distinct,
        round(count(distinct {c})::double / count(*), 6) as distinct_ratio from events"""
        for c in _EVENT_COLUMNS
    )
    + ") where distinct_ratio > 0.7",
    "describe": _union(
        [_describe_number(c) for c in LINE_NUMBERS] + [_describe_other(c) for c in LINE_OTHERS]
    ),
    "correlation": _corr_sql(LINE_NUMBERS, "lineitem"),
    "correlation_with_nulls": f"""
with d as (select o_orderkey, price from {DIRTY_DUCK})
{_corr_sql(("o_orderkey", "price"), "d")}
union all select x, y, 0.0::double as corr from (values ('constant', 'o_orderkey'), ('constant', 'price'),
  ('o_orderkey', 'constant'), ('price', 'constant'), ('constant', 'constant')) v(x, y)""",
    "data_bytes": _union(
        [
            f"select '{c}' as column_name, sum(strlen({c}))::bigint as n_bytes from documents"
            for c in ("text", "lang", "source")
        ]
        + [
            f"select '{c}' as column_name, (8 * count({c}))::bigint as n_bytes from documents"
            for c in ("doc_id", "n_chars")
        ]
    ),
    "duplicate_count": f"""select (count(*) - (select count(*) from
        (select distinct * from {DUP_DUCK})))::bigint as duplicate_rows from {DUP_DUCK}""",
    "cleaning_report": f"""
select a.*, b.duplicate_rows from ({_union(_null_sql(c, DUP_DUCK) for c in _EVENT_COLUMNS)}) a,
  (select (count(*) - (select count(*) from (select distinct * from {DUP_DUCK})))::bigint
     as duplicate_rows from {DUP_DUCK}) b""",
    "compare_schema": """
select * from (values ('o_orderkey', 'same', 'bigint', 'bigint'),
  ('o_custkey', 'type_mismatch', 'bigint', 'string'), ('o_orderstatus', 'same', 'string', 'string'),
  ('o_totalprice', 'same', 'double', 'double'),
  ('o_orderdate', 'same', 'timestamp_ntz', 'timestamp_ntz'),
  ('o_orderpriority', 'only_in_1', 'string', null), ('priority', 'only_in_2', null, 'string'))
  v(column_name, status, type_1, type_2)""",
    "compare_shape": f"""select 'df1' as dataset, count(*) as n_rows, 6::bigint as n_columns from {_EARLY}
union all select 'df2', count(*), 6 from {_LATE}""",
    "numeric_drift": _union(_drift_sql(c) for c in ("o_orderkey", "o_totalprice")),
    "sparse_profile": _union(
        _null_sql(c, SPARSE_DUCK) for c in ("order_key", "status", "half_null")
    ),
}
