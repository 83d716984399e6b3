"""What is in the catalog: tables, columns, row counts, previews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = "table_name string, column_name string, type string, position bigint"


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def describe_catalog(spark: SparkSession, tables: Sequence[str] | None = None) -> DataFrame:
    """``(table_name, column_name, type, position)`` from metadata alone."""
    rows = [
        (t, f.name, f.dataType.simpleString(), i)
        for t in (tables or table_names(spark))
        for i, f in enumerate(spark.table(t).schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, _COLUMNS)


def schema_text(spark: SparkSession, tables: Sequence[str] | None = None) -> str:
    """The schema as readable text, one block per table."""
    names = list(tables or table_names(spark))
    if not names:
        raise ValueError("No tables found.")
    blocks = []
    for t in names:
        fields = spark.table(t).schema.fields
        lines = [f" - {f.name} ({f.dataType.simpleString()})" for f in fields]
        blocks.append("\n".join([f"Table: {t}", *lines]))
    return "\n\n".join(blocks)


def table_counts(spark: SparkSession, tables: Sequence[str] | None = None) -> DataFrame:
    """``(table_name, columns, n_rows)``, one union of counts."""
    names = list(tables or table_names(spark))
    if not names:
        raise ValueError("No tables found.")

    def count(t: str) -> DataFrame:
        df = spark.table(t)
        listed = F.array(*(F.lit(c) for c in df.columns))
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(t).alias("table_name"), F.array_join(listed, ",").alias("columns"), "n_rows"
        )

    return reduce(DataFrame.unionByName, (count(t) for t in names))


def preview(df: DataFrame, n: int = 5, order: Sequence[str | Column] = ()) -> DataFrame:
    """The first rows; with ``order`` a top-n, without it any n rows."""
    return (df.orderBy(*order) if order else df).limit(n)
