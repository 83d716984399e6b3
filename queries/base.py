"""Inputs shared by the registered queries: the given tables and dirt derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fmt: off
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
# fmt: on


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names=TABLES) -> None:
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


_DIRTY = """
select o_orderkey,
  case when o_orderkey % 11 = 0 then null when o_orderkey % 11 = 1 then 'N/A'
       when o_orderkey % 11 = 2 then 'n/a' else concat('  ', o_orderstatus, '  x ') end as status_raw,
  concat('$', cast(cast(o_totalprice as decimal(18,2)) as {text})) as price_usd,
  concat(cast(o_orderkey % 100 as {text}), '%') as pct,
  case when o_orderkey % 2 = 0 then 'Yes' else 'no' end as flag,
  concat(o_orderstatus, '|', cast(o_custkey as {text})) as compound,
  case when o_orderkey % 13 = 0 then null else o_totalprice end as price
from orders
"""
DIRTY_SPARK = _DIRTY.format(text="string")
DIRTY_DUCK = f"({_DIRTY.format(text='varchar')})"


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("orders")
    return spark.sql(DIRTY_SPARK)


def dup_events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.unionByName(events.where("event_id % 10 = 0"))


DUP_DUCK = "(select * from events union all select * from events where event_id % 10 = 0)"


def sparse_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with empty rows, a constant column and a column that is almost all NULL."""
    return table(spark, folder, "orders").selectExpr(
        "case when o_orderkey % 20 = 0 then null else o_orderkey end as `Order Key`",
        "case when o_orderkey % 20 = 0 then null else o_orderstatus end as `Status`",
        "case when o_orderkey % 20 = 0 then null else 7 end as constant",
        "case when o_orderkey % 100 = 1 then o_custkey end as `mostly-null`",
        "case when o_orderkey % 20 = 0 then null when o_orderkey % 2 = 0 then o_totalprice end "
        "as half_null",
    )


SPARSE_DUCK = """(select * from (select
  case when o_orderkey % 20 = 0 then null else o_orderkey end as order_key,
  case when o_orderkey % 20 = 0 then null else o_orderstatus end as status,
  case when o_orderkey % 20 = 0 then null when o_orderkey % 2 = 0 then o_totalprice end as half_null
  from orders) where order_key is not null)"""
