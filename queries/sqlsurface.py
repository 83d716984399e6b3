"""Guarded SELECTs: every relational operator the SQL surface offers, and the catalog queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millrace.operators import catalog, sqlq
from millrace.operators.ranges import range_counts, range_join
from queries.base import TABLES, register, table

# One text per query, understood by both engines.
STATEMENTS = {
    "sql_filter": """
select l_orderkey, l_linenumber, l_quantity,
  case when l_discount > 0.05 then 'high' else 'low' end as discount_band
from lineitem
where l_shipdate >= timestamp '1997-01-01' and l_quantity between 10 and 20
  and l_returnflag in ('A', 'R') and l_linestatus like 'F%'""",
    "sql_join": """
select n_name, r_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total
from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by n_name, r_name""",
    "sql_left_join": """
select c_custkey, count(o_orderkey) as n_orders
from customer left join orders on o_custkey = c_custkey and o_totalprice > 400000
group by c_custkey""",
    "sql_semi_anti": """
select c_custkey, 'buyer' as kind from customer
where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')
union all
select c_custkey, 'idle' as kind from customer
where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')""",
    "sql_theta_join": """
select p_brand, count(*) as n_lines from lineitem join part
  on l_partkey = p_partkey and l_extendedprice / l_quantity > p_retailprice
group by p_brand""",
    "sql_range_join": """
select o_orderpriority, count(*) as n_late
from orders join lineitem on o_orderkey = l_orderkey
  and l_shipdate between o_orderdate and o_orderdate + interval 365 day
group by o_orderpriority""",
    "sql_agg": """
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty,
  round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc,
  min(l_extendedprice) as min_price, max(l_extendedprice) as max_price, count(*) as n
from lineitem where l_shipdate <= timestamp '2000-09-02'
group by l_returnflag, l_linestatus""",
    "sql_having": """
select l_suppkey, count(distinct l_partkey) as n_parts, round(sum(l_quantity), 2) as qty
from lineitem group by l_suppkey having count(distinct l_partkey) > 10""",
    "sql_window_rank": """
select o_custkey, o_orderkey, rk, prev_price, next_price, running from (
  select o_custkey, o_orderkey,
    cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as rk,
    lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev_price,
    lead(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as next_price,
    round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey
      rows between 2 preceding and current row), 2) as running
  from orders) t
where rk <= 3""",
    "sql_window_turns": """
select conv_id, turn, role,
  cast(dense_rank() over (partition by conv_id order by role) as bigint) as role_rank,
  count(*) over (partition by conv_id) as n_turns
from conversations""",
    "sql_topk": """
select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10""",
    "sql_offset": """
select p_partkey, p_retailprice from part order by p_retailprice, p_partkey limit 10 offset 5""",
    "sql_setops": """
select s_nationkey as k, 'both' as kind from supplier intersect select c_nationkey, 'both' from customer
union all
(select o_custkey, 'without' from orders except select c_custkey, 'without' from customer where c_acctbal < 0)
union all
(select event_type_len, 'union' from (select length(event_type) as event_type_len from events
  union select length(lang) from documents) u)""",
    "sql_subquery": """
select c_custkey, c_acctbal from customer c
where c_acctbal > (select avg(c_acctbal) from customer)
  and c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')""",
    "sql_correlated": """
select o_custkey, o_orderkey, o_totalprice from orders o
where o_totalprice = (select max(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey)""",
}


def _runner(sql: str):
    def run(spark, d):
        register(spark, d, [t for t in TABLES if re.search(rf"\b{t}\b", sql)])
        return sqlq.run_select(spark, f"```sql\n{sql.strip()};\n```")

    return run


def ask_question(spark, d):
    """A question answered by a translator that looks only at the prompt it gets."""
    register(spark, d)

    def translate(prompt: str) -> str:
        name = next(t for t in ("orders", "lineitem") if f"Table: {t}" in prompt)
        return f"```sql\nselect o_orderstatus, count(*) as n from {name} group by 1;\n```"

    return sqlq.SqlAgent(spark, translate, list(TABLES)).ask("How many orders per status?").result


def catalog_columns(spark, d):
    register(spark, d)
    return catalog.describe_catalog(spark, TABLES)


def table_counts(spark, d):
    register(spark, d)
    return catalog.table_counts(spark, TABLES)


def preview_rows(spark, d):
    return catalog.preview(table(spark, d, "orders").drop("o_orderdate"), 5, [F.col("o_orderkey")])


def range_join_prices(spark, d):
    """Lines whose price lies at most 1 above an order's total, per order priority; no column is equated."""
    lines = table(spark, d, "lineitem").select("l_extendedprice")
    orders = table(spark, d, "orders").selectExpr("o_orderpriority", "o_totalprice as low", "o_totalprice + 1 as high")
    met = range_counts(lines, orders, "l_extendedprice", "low", "high").where("n > 0")
    return met.groupBy("o_orderpriority").agg(F.sum("n").alias("n_lines"), F.min("least").alias("least"))


def range_join_times(spark, d):
    """Every event with every purchase of the ten minutes before it."""
    events = table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").selectExpr("event_id as purchase_id", "ts as since", "ts + interval 10 minutes as until")
    met = range_join(events.select("event_id", "ts", "user_id"), bought, "ts", "since", "until", open_end=True)
    return met.select("event_id", "user_id", "purchase_id")


QUERIES = {name: _runner(sql) for name, sql in STATEMENTS.items()} | {
    f.__name__: f for f in (ask_question, catalog_columns, table_counts, preview_rows, range_join_prices, range_join_times)
}

_NAMES = ", ".join(f"'{t}'" for t in TABLES)

ORACLES = STATEMENTS | {
    "ask_question": "select o_orderstatus, count(*) as n from orders group by 1",
    "catalog_columns": f"""
select table_name, column_name, case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int'
  when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz'
  when 'FLOAT[]' then 'array<float>' else data_type end as type,
  ordinal_position::bigint as position
from information_schema.columns where table_name in ({_NAMES})""",
    "table_counts": "\nunion all\n".join(
        f"""select '{t}' as table_name, (select string_agg(column_name, ',' order by ordinal_position)
        from information_schema.columns where table_name = '{t}') as columns, count(*) as n_rows from {t}"""
        for t in TABLES
    ),
    "range_join_prices": """
select o_orderpriority, count(*) as n_lines, min(l_extendedprice) as least
from lineitem join orders on l_extendedprice >= o_totalprice and l_extendedprice <= o_totalprice + 1
group by o_orderpriority""",
    "range_join_times": """
select e.event_id, e.user_id, b.event_id as purchase_id
from events e join events b on b.event_type = 'purchase' and e.ts >= b.ts and e.ts < b.ts + interval 10 minute""",
    "preview_rows": "select * exclude (o_orderdate) from orders order by o_orderkey limit 5",
}
