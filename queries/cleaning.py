"""Cleaning steps, one by one and all together."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import parse, text
from millrace.operators import fingerprints, lookup, names, rows
from millrace.operators.codes import CodeBook
from millrace.operators.frequency import modes
from millrace.operators.quantiles import exact_quantiles
from millrace.plans.cleaning import clip_numeric, enforce_schema, positive_only, winsorize
from millrace.plans.config import CleanerConfig
from millrace.plans.fit import clean, fit
from millrace.plans.growth import load_plan, save_plan, with_new_levels
from millrace.session import scratch_path, spread
from queries.base import DIRTY_DUCK, DUP_DUCK, SPARSE_DUCK, dirty_orders, dup_events
from queries.base import sparse_orders, table

NULLS = "('', 'na', 'n/a', 'null', 'nan', '-', '--', 'none', 'Nil', 'NIL', 'NULL', 'NaN')"
SEGMENTS = {"automobile": "vehicles", "building": "construction", "machinery": "machines"}


def _bare_text(**options):
    """Only the given steps: no limits, no imputation, no flags, no de-duplication."""
    quiet = {
        "drop_constant_columns": False,
        "drop_col_null_threshold": None,
        "winsorize_lower_q": None,
        "winsorize_upper_q": None,
        "impute_numeric": False,
        "impute_categorical": False,
        "mark_outliers_zscore": False,
        "dedupe": False,
        "normalize_case_categoricals": "none",
        "id_like_columns_first": False,
    }
    return CleanerConfig(**(quiet | options))


def _fitted(df, **options):
    df = spread(df)
    return fit(df, _bare_text(**options)).transform(df)


# ---- names, rows and columns ----


def normalize_names(spark, d):
    orders = table(spark, d, "orders")
    odd = orders.toDF(" Order Key", "order-key", "Status", "Total  Price", "Date", "Pri.ority")
    return names.normalize_column_names(odd).select(
        "order_key", "order_key_2", "status", "total_price", F.col("pri_ority")
    )


def drop_empty_constant_null_cols(spark, d):
    df = sparse_orders(spark, d)
    return _fitted(df, drop_constant_columns=True, drop_col_null_threshold=0.97)


def clean_report(spark, d):
    df = sparse_orders(spark, d)
    config = _bare_text(drop_constant_columns=True, drop_col_null_threshold=0.97)
    _, report = clean(df, config)
    return report.where(F.col("step").startswith("drop_")).select(
        "step",
        "rows_before",
        F.col("cols_before").cast("bigint").alias("cols_before"),
        "rows_after",
        F.col("cols_after").cast("bigint").alias("cols_after"),
        "skipped",
    )


# ---- text ----


def clean_strings(spark, d):
    c = text.tidy_text(F.col("status_raw"))
    tidy = dirty_orders(spark, d).select("o_orderkey", c.alias("status"))
    return tidy.withColumn("status", F.lower(text.null_if_placeholder(F.col("status"))))


def text_steps(spark, d):
    """Strip, invisible characters, white space runs, ASCII, case: each on whole documents."""
    t = F.concat(F.lit(" \t\ufeff"), F.col("text"), F.lit("\u200b\n"))
    return table(spark, d, "documents").select(
        "doc_id",
        F.md5(text.strip_space(F.concat(F.lit(" \t"), F.col("text"), F.lit(" \n")))).alias("stripped"),
        F.md5(text.drop_invisible(t)).alias("visible"),
        F.md5(text.keep_ascii(t)).alias("ascii"),
        F.md5(text.set_case(F.col("lang"), "upper")).alias("upper_lang"),
    )


# ---- typed columns ----


def _numbers(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "case when o_orderkey % 17 = 0 then 'abc' when o_orderkey % 17 = 1 then '5d' "
        "when o_orderkey % 17 = 2 then '-' when o_orderkey % 17 = 3 then 'inf' "
        "else concat(cast(o_custkey as string), ',', lpad(cast(o_orderkey % 1000 as string), 3, '0'), '.5') "
        "end as amount",
    )


def coerce_numeric(spark, d):
    return _fitted(_numbers(spark, d))


def coerce_datetime(spark, d):
    df = table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "case when o_orderkey % 19 = 0 then 'n.a.' when o_orderkey % 19 = 1 then '1997/13/45' "
        "else date_format(o_orderdate, 'yyyy/MM/dd') end as day",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") as moment",
        "o_orderpriority",
    )
    out = _fitted(df, split_delimiters=("|",))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("o_orderkey", show("day"), show("moment"), "o_orderpriority")


def parse_percent(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "pct")
    return _fitted(df).withColumn("pct", F.round("pct", 6))


def parse_currency(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "price_usd")
    return _fitted(df)


def normalize_bool(spark, d):
    return _fitted(dirty_orders(spark, d).select("o_orderkey", "flag"))


def parse_helpers(spark, d):
    """The typed readings as column functions, on mixed text."""
    mixed = F.expr(
        "case o_orderkey % 7 when 0 then '12.5%' when 1 then '12,5%' when 2 then '$1,234.50' "
        "when 3 then ' TRUE ' when 4 then '{\"a\": 1}' when 5 then '7' "
        "else concat('no. ', cast(o_custkey as string)) end"
    )
    m = F.col("m")
    return table(spark, d, "orders").select("o_orderkey", mixed.alias("m")).select(
        "o_orderkey",
        parse.to_number(m).alias("number"),
        parse.to_fraction(m).alias("fraction"),
        parse.to_amount(m).alias("amount"),
        parse.to_bool(m).alias("truth"),
        text.looks_like_json(m).alias("json"),
        parse.first_number(m).alias("first"),
    )


# ---- synonyms, JSON, parts, numbers ----


def synonyms(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return lookup.apply_synonyms(df, "c_mktsegment", SEGMENTS)


def synonyms_table(spark, d):
    """The mapping taken from a table: part brands renamed by the part's number."""
    part = table(spark, d, "part")
    mapping = part.groupBy("p_name").agg(
        F.concat(F.lit("part "), F.min("p_partkey").cast("string")).alias("first_key")
    )
    df = part.select("p_partkey", "p_name")
    return lookup.apply_synonym_table(df, "p_name", mapping, "p_name", "first_key")


def json_expand(spark, d):
    return _fitted(table(spark, d, "events").select("event_id", "props"))


def json_expand_nested(spark, d):
    df = table(spark, d, "events").selectExpr(
        "event_id",
        "concat('{\"user\": {\"id\": ', user_id, ', \"kind\": \"', event_type, '\"}, \"v\": ', value, "
        "case when event_id % 3 = 0 then ', \"tags\": [1, 2]' else '' end, '}') as doc",
    )
    return _fitted(df, split_delimiters=("|",)).withColumnsRenamed(
        {"doc__user.id": "doc__user_id", "doc__user.kind": "doc__user_kind"}
    )


def json_expand_case(spark, d):
    """Keys that differ in case only, and one with both kinds of quotes."""
    df = table(spark, d, "events").selectExpr(
        "event_id",
        "concat('{\"ID\": ', user_id, ', \"id\": ', event_id, case when event_id % 4 = 0 then "
        "', \"it''s \\\\\"so\\\\\"\": 1' else '' end, '}') as doc",
    )
    out = _fitted(df, split_delimiters=("|",))
    return out.select("event_id", "doc__ID", "doc__id_2", F.col("doc__rest").isNotNull().alias("has_rest"))


def json_expand_mixed(spark, d):
    """A column of objects with arrays and broken documents in between: those are kept whole."""
    df = table(spark, d, "events").selectExpr(
        "event_id", "case when event_id % 10 = 0 then '[0, 9]' when event_id % 10 = 1 then '{broken}' else props end as doc"
    )
    return _fitted(df, split_delimiters=("|",))


def transform_later_batch(spark, d):
    """A plan fitted on two parts, two JSON keys and three levels, applied to rows that have more."""
    events = table(spark, d, "events")
    plain = events.selectExpr(
        "event_id", "concat(event_type, '|', event_type) as parts", "concat('{\"a\": ', user_id, '}') as doc", "event_type as kind"
    )
    plan = fit(plain, _bare_text(enforce_schema={"kind": "category"}))
    later = events.selectExpr(
        "event_id", "concat(event_type, '|x|y') as parts",
        "concat('{\"a\": ', user_id, case when event_id % 2 = 0 then ', \"b\": 2' else '' end, '}') as doc", "'new kind' as kind",
    )
    return plan.transform(later)


def growing_codes(spark, d):
    """Customer codes from three batches of orders by year; later ones go behind the codes that are there."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), "o_orderdate")
    book, folder = CodeBook(), scratch_path(spark, "codes")
    for low, high in ((0, 1994), (1994, 1996), (1996, 9999)):
        book = book.grown(orders.where(F.year("o_orderdate").between(low, high - 1)), "customer", folder)
    return book.encode(orders, "customer", "code").select("o_orderkey", "customer", "code")


def grown_plan(spark, d):
    """A plan fitted on two days of the week, kept in a folder, read again and grown by the other days twice."""
    events = table(spark, d, "events").selectExpr(
        "event_id", "concat(event_type, ' ', substr('abcdefg', dayofweek(ts), 1)) as kind", "dayofweek(ts) as day"
    )
    plan = fit(events.where("day <= 2").drop("day"), _bare_text(enforce_schema={"kind": "category"}))
    for days in ("day in (3, 4)", "day >= 5"):
        plan = with_new_levels(plan, events.where(days).drop("day"))
        folder = scratch_path(spark, "plan")
        save_plan(plan, spark, folder)
        plan = load_plan(spark, folder)
    return plan.transform(events.drop("day"))


def synonyms_duplicate_keys(spark, d):
    """Mapping keys that agree in lower case do not multiply rows; the smallest target counts."""
    segments = table(spark, d, "customer").select("c_mktsegment").distinct()
    mapping = segments.selectExpr("c_mktsegment as k", "'b' as v").unionAll(segments.selectExpr("lower(c_mktsegment)", "'a'"))
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return lookup.apply_synonym_table(df, "c_mktsegment", mapping, "k", "v")


def split_compound(spark, d):
    return _fitted(dirty_orders(spark, d).select("o_orderkey", "compound")).drop(
        "compound_part2_num"
    )


def extract_numbers(spark, d):
    return _fitted(table(spark, d, "part").select("p_partkey", "p_brand"))


# ---- numbers ----


def winsorize_numeric(spark, d):
    df = table(spark, d, "events").select("event_id", "value", "user_id")
    found = exact_quantiles(df, ["value", "user_id"], [0.01, 0.99])
    out = winsorize(df, {c: tuple(q) for c, q in found.items()})
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in ("value", "user_id")))


def clip_range(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return clip_numeric(df, 100, 5000)


def positive_columns(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return positive_only(df, ["c_acctbal"])


def impute_numeric(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "price")
    out = _fitted(df, impute_numeric=True)
    return out.withColumn("price", F.round("price", 4))


def impute_categorical(spark, d):
    return _fitted(
        dirty_orders(spark, d).select("o_orderkey", "status_raw"), impute_categorical=True
    )


def impute_mode(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "status_raw")
    fill = modes(df, ["status_raw"])["status_raw"]
    return df.fillna({"status_raw": fill})


def mark_outliers(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    out = _fitted(df, mark_outliers_zscore=True)
    return out.select("event_id", "value_is_outlier")


# ---- duplicates, codes, schema ----


def dedupe_rows(spark, d):
    out = rows.dedupe_rows(dup_events(spark, d))
    return out.select("event_id", "user_id", "event_type", "value", "props")


def dedupe_by_key(spark, d):
    df = dup_events(spark, d).select("event_id", "user_id", "event_type", "value")
    return rows.dedupe_rows(df, ["user_id", "event_type"], [-F.col("value")])


def distinct_by_fingerprint(spark, d):
    """Distinct documents, an eighth of them there twice; only fingerprints and possible copies are shuffled."""
    docs = table(spark, d, "documents")
    return fingerprints.distinct_rows(docs.unionByName(docs.where("doc_id % 8 = 0")))


def copies_by_fingerprint(spark, d):
    return fingerprints.count_copies(dup_events(spark, d))


def dictionary_encode(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return lookup.dictionary_encode(df, ["p_brand", "p_type"])


def rename_cast_reorder(spark, d):
    df = table(spark, d, "orders").select(
        "o_totalprice", "o_orderstatus", "o_custkey", F.col("o_orderkey").cast("string")
    )
    df = names.rename_columns(df, {"o_orderkey": "order_id", "o_totalprice": "total"})
    wanted = {"order_id": "int", "o_custkey": "str", "total": "float", "o_orderstatus": "category"}
    return names.reorder_columns(enforce_schema(df, wanted))


# ---- everything ----


def clean_table(spark, d):
    cleaned, _ = clean(spread(dirty_orders(spark, d)))
    decimals = [f.name for f in cleaned.schema.fields if f.dataType.simpleString() == "double"]
    return cleaned.withColumns({c: F.round(c, 4) for c in decimals})


QUERIES = {
    f.__name__: f
    for f in (
        normalize_names,
        drop_empty_constant_null_cols,
        clean_report,
        clean_strings,
        text_steps,
        coerce_numeric,
        coerce_datetime,
        parse_percent,
        parse_currency,
        normalize_bool,
        parse_helpers,
        synonyms,
        synonyms_table,
        json_expand,
        json_expand_nested,
        json_expand_case,
        json_expand_mixed,
        transform_later_batch,
        growing_codes,
        grown_plan,
        synonyms_duplicate_keys,
        split_compound,
        extract_numbers,
        winsorize_numeric,
        clip_range,
        positive_columns,
        impute_numeric,
        impute_categorical,
        impute_mode,
        mark_outliers,
        dedupe_rows,
        dedupe_by_key,
        distinct_by_fingerprint,
        copies_by_fingerprint,
        dictionary_encode,
        rename_cast_reorder,
        clean_table,
    )
}


def _limits(column: str, source: str, low: str = "0.01", high: str = "0.99") -> str:
    return (
        f"(select quantile_cont({column}, {low}) as lo, quantile_cont({column}, {high}) as hi "
        f"from {source})"
    )


_CLEAN_TABLE = f"""
with d as {DIRTY_DUCK},
t as (
  select cast(o_orderkey as double) as o_orderkey,
    case when trim(regexp_replace(status_raw, '\\s+', ' ', 'g')) in {NULLS} then null
         else lower(trim(regexp_replace(status_raw, '\\s+', ' ', 'g'))) end as status_raw,
    cast(replace(price_usd, '$', '') as double) as price_usd,
    cast(replace(pct, '%', '') as double) / 100 as pct,
    flag = 'Yes' as flag,
    price,
    lower(split_part(compound, '|', 1)) as compound_part1,
    split_part(compound, '|', 2) as compound_part2,
    cast(split_part(compound, '|', 2) as double) as compound_part2_num
  from d),
q as (
  select
    quantile_cont(o_orderkey, 0.01) as k1, quantile_cont(o_orderkey, 0.99) as k2,
    quantile_cont(price_usd, 0.01) as u1, quantile_cont(price_usd, 0.99) as u2,
    quantile_cont(pct, 0.01) as p1, quantile_cont(pct, 0.99) as p2,
    quantile_cont(price, 0.01) as c1, quantile_cont(price, 0.99) as c2,
    quantile_cont(compound_part2_num, 0.01) as n1, quantile_cont(compound_part2_num, 0.99) as n2
  from t),
w as (
  select
    greatest(least(o_orderkey, k2), k1) as o_orderkey, status_raw,
    greatest(least(price_usd, u2), u1) as price_usd,
    greatest(least(pct, p2), p1) as pct, flag,
    case when price is not null then greatest(least(price, c2), c1) end as price,
    compound_part1, compound_part2,
    greatest(least(compound_part2_num, n2), n1) as compound_part2_num
  from t, q),
i as (
  select * replace (
    coalesce(status_raw, 'unknown') as status_raw,
    coalesce(price, (select median(price) from w)) as price)
  from w),
z as (
  select avg(o_orderkey) as km, stddev_pop(o_orderkey) as ks,
    avg(price_usd) as um, stddev_pop(price_usd) as us, avg(pct) as pm, stddev_pop(pct) as ps,
    avg(price) as cm, stddev_pop(price) as cs,
    avg(compound_part2_num) as nm, stddev_pop(compound_part2_num) as ns
  from i)
select distinct
  round(o_orderkey, 4) as o_orderkey, status_raw, round(price_usd, 4) as price_usd,
  round(pct, 4) as pct, flag, round(price, 4) as price, compound_part1, compound_part2,
  round(compound_part2_num, 4) as compound_part2_num,
  abs(o_orderkey - km) > 3 * ks as o_orderkey_is_outlier,
  abs(price_usd - um) > 3 * us as price_usd_is_outlier,
  abs(pct - pm) > 3 * ps as pct_is_outlier,
  abs(price - cm) > 3 * cs as price_is_outlier,
  abs(compound_part2_num - nm) > 3 * ns as compound_part2_num_is_outlier
from i, z
"""

_MIXED = """(select o_orderkey, case o_orderkey % 7 when 0 then '12.5%' when 1 then '12,5%'
  when 2 then '$1,234.50' when 3 then ' TRUE ' when 4 then '{"a": 1}' when 5 then '7'
  else concat('no. ', cast(o_custkey as varchar)) end as m from orders)"""

ORACLES = {
    "normalize_names": "select o_orderkey as order_key, o_custkey as order_key_2, "
    "o_orderstatus as status, o_totalprice as total_price, o_orderpriority as pri_ority from orders",
    "drop_empty_constant_null_cols": f"select * from {SPARSE_DUCK}",
    "clean_report": """
select step, case when step = 'drop_empty_rows' then a else f end as rows_before, cols_before,
  f as rows_after, cols_after, false as skipped
from (values ('drop_empty_rows', 5::bigint, 5::bigint), ('drop_constant_columns', 5, 4),
  ('drop_high_null_columns', 4, 3)) v(step, cols_before, cols_after),
  (select count(*) as a, count(*) filter (where o_orderkey % 20 <> 0) as f from orders)""",
    "clean_strings": f"""
select o_orderkey, case when s in {NULLS} then null else lower(s) end as status
from (select o_orderkey, trim(regexp_replace(status_raw, '\\s+', ' ', 'g')) as s from {DIRTY_DUCK})""",
    "text_steps": """
select doc_id,
  md5(regexp_replace(concat(chr(32), chr(9), text, chr(32), chr(10)), '^\\s+|\\s+$', '', 'g')) as stripped,
  md5(regexp_replace(t, '[\\x{200B}-\\x{200D}\\x{FEFF}]', '', 'g')) as visible,
  md5(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) as ascii,
  md5(upper(lang)) as upper_lang
from (select *, concat(chr(32), chr(9), chr(65279), text, chr(8203), chr(10)) as t from documents)""",
    "coerce_numeric": """
select o_orderkey, case when o_orderkey % 17 > 3
  then cast(concat(cast(o_custkey as varchar), lpad(cast(o_orderkey % 1000 as varchar), 3, '0'), '.5') as double)
  end as amount from orders""",
    "coerce_datetime": """
select o_orderkey,
  case when o_orderkey % 19 > 1 then strftime(o_orderdate, '%Y-%m-%d 00:00:00') end as day,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as moment, o_orderpriority from orders""",
    "parse_percent": f"select o_orderkey, round(cast(replace(pct, '%', '') as double) / 100, 6) as pct "
    f"from {DIRTY_DUCK}",
    "parse_currency": f"select o_orderkey, cast(replace(price_usd, '$', '') as double) as price_usd "
    f"from {DIRTY_DUCK}",
    "normalize_bool": f"select o_orderkey, flag = 'Yes' as flag from {DIRTY_DUCK}",
    "parse_helpers": f"""
select o_orderkey, case o_orderkey % 7 when 5 then 7.0::double end as number,
  case o_orderkey % 7 when 0 then 0.125::double when 1 then 0.125::double when 5 then 0.07::double end as fraction,
  case o_orderkey % 7 when 2 then 1234.5::double when 5 then 7.0::double end as amount,
  case o_orderkey % 7 when 3 then true end as truth,
  o_orderkey % 7 = 4 as json,
  try_cast(nullif(regexp_extract(m, '([-+]?\\d*\\.?\\d+)', 1), '') as double) as first
from {_MIXED}""",
    "synonyms": """
select c_custkey, case lower(c_mktsegment) when 'automobile' then 'vehicles'
  when 'building' then 'construction' when 'machinery' then 'machines'
  else lower(c_mktsegment) end as c_mktsegment from customer""",
    "synonyms_table": """
select p_partkey, concat('part ', cast(min(p_partkey) over (partition by p_name) as varchar)) as p_name
from part""",
    "json_expand": "select event_id, cast(json_extract(props, '$.k') as bigint) as props__k, "
    "null::varchar as props__rest from events",
    "json_expand_case": """
select event_id, user_id as "doc__ID", event_id as doc__id_2, event_id % 4 = 0 as has_rest from events""",
    "json_expand_mixed": """
select event_id, case when event_id % 10 > 1 then cast(json_extract(props, '$.k') as bigint) end as doc__k,
  case event_id % 10 when 0 then '[0, 9]' when 1 then '{broken}' end as doc__rest from events""",
    "transform_later_batch": """
select event_id, event_type as parts_part1, 'x|y' as parts_part2, user_id as doc__a,
  case when event_id % 2 = 0 then concat('{"a": ', user_id, ', "b": 2}') end as doc__rest,
  (select count(distinct event_type) from events) as kind from events""",
    "growing_codes": """
with b as (select o_custkey, case when year(min(o_orderdate)) < 1994 then 0 when year(min(o_orderdate)) < 1996 then 1 else 2 end as batch
  from orders group by 1),
c as (select o_custkey, row_number() over (order by batch, cast(o_custkey as varchar)) - 1 as code from b)
select o_orderkey, cast(o_custkey as varchar) as customer, code from orders join c using (o_custkey)""",
    "grown_plan": """
select event_id, dense_rank() over (order by case when day <= 2 then 0 when day <= 4 then 1 else 2 end, kind) - 1 as kind
from (select event_id, dayofweek(ts) + 1 as day, concat(event_type, ' ', substr('abcdefg', dayofweek(ts) + 1, 1)) as kind from events)""",
    "synonyms_duplicate_keys": "select c_custkey, 'a' as c_mktsegment from customer",
    "json_expand_nested": """
select event_id, user_id as doc__user_id, event_type as doc__user_kind, value as doc__v,
  case when event_id % 3 = 0 then '[1,2]' end as doc__tags, null::varchar as doc__rest from events""",
    "split_compound": f"select o_orderkey, split_part(compound, '|', 1) as compound_part1, "
    f"split_part(compound, '|', 2) as compound_part2 from {DIRTY_DUCK}",
    "extract_numbers": "select p_partkey, p_brand, "
    "try_cast(regexp_extract(p_brand, '([-+]?\\d*\\.?\\d+)', 1) as double) as p_brand_num from part",
    "winsorize_numeric": f"""
select event_id, round(greatest(least(value, v.hi), v.lo), 6) as value,
  round(greatest(least(cast(user_id as double), u.hi), u.lo), 6) as user_id
from events, {_limits("value", "events")} v, {_limits("cast(user_id as double)", "events")} u""",
    "clip_range": "select greatest(least(c_custkey, 5000), 100) as c_custkey, greatest(least(c_acctbal, 5000), 100) as c_acctbal from customer",
    "positive_columns": "select c_custkey, greatest(c_acctbal, 0) as c_acctbal from customer",
    "impute_numeric": f"""
with d as {DIRTY_DUCK}
select o_orderkey, round(coalesce(price, (select median(price) from d)), 4) as price from d""",
    "impute_categorical": f"""
select o_orderkey, coalesce(case when s in {NULLS} then null else s end, 'unknown') as status_raw
from (select o_orderkey, trim(regexp_replace(status_raw, '\\s+', ' ', 'g')) as s from {DIRTY_DUCK})""",
    "impute_mode": f"""
with d as {DIRTY_DUCK}
select o_orderkey, coalesce(status_raw, (select status_raw from d where status_raw is not null
  group by 1 order by count(*) desc, 1 limit 1)) as status_raw from d""",
    "mark_outliers": """
select event_id, abs(value - m) > 3 * s as value_is_outlier
from events, (select avg(value) as m, stddev_pop(value) as s from events)""",
    "dedupe_rows": f"select distinct event_id, user_id, event_type, value, props from {DUP_DUCK}",
    "dedupe_by_key": f"""
select event_id, user_id, event_type, value from (select *, row_number() over (
  partition by user_id, event_type order by value desc, event_id) as rn from {DUP_DUCK}) where rn = 1""",
    "distinct_by_fingerprint": "select distinct * from documents",
    "copies_by_fingerprint": f"""
select sum(n)::bigint as n_rows, count(*) as n_distinct, (sum(n) - count(*))::bigint as n_copies, max(n) as largest_group
from (select count(*) as n from {DUP_DUCK} group by event_id, ts, user_id, event_type, value, props)""",
    "dictionary_encode": """
select p_partkey, p_brand, p_type, dense_rank() over (order by p_brand) - 1 as p_brand_code,
  dense_rank() over (order by p_type) - 1 as p_type_code from part""",
    "rename_cast_reorder": """
select o_orderkey as order_id, o_totalprice as total,
  dense_rank() over (order by o_orderstatus) - 1 as o_orderstatus,
  cast(o_custkey as varchar) as o_custkey from orders""",
    "clean_table": _CLEAN_TABLE,
}
