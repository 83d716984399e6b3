"""Comparing two tables: schema, shape and numeric drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.longform import number_columns
from millrace.operators.profile import number_summary

_SCHEMA = "column_name string, status string, type_1 string, type_2 string"


def compare_schema(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per column of either side: ``only_in_1``, ``only_in_2``, ``type_mismatch``, ``same``."""
    a = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    b = {f.name: f.dataType.simpleString() for f in right.schema.fields}

    def status(name: str) -> str:
        if name not in b:
            return "only_in_1"
        if name not in a:
            return "only_in_2"
        return "same" if a[name] == b[name] else "type_mismatch"

    rows = [(n, status(n), a.get(n), b.get(n)) for n in sorted({*a, *b})]
    return left.sparkSession.createDataFrame(rows, _SCHEMA)


def compare_shape(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(dataset, n_rows, n_columns)`` for both sides."""

    def shape(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )

    return shape(left, "df1").unionByName(shape(right, "df2"))


def numeric_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean, deviation, minimum and maximum of the numeric columns both sides have."""
    other = set(number_columns(right, with_bool=True))
    shared = [c for c in number_columns(left, with_bool=True) if c in other]

    def side(df: DataFrame, n: int) -> DataFrame:
        s = number_summary(df, shared)
        return s.select(
            "column_name", *(F.col(k).alias(f"{k}_{n}") for k in ("mean", "std", "min", "max"))
        )

    return side(left, 1).join(side(right, 2), "column_name", "full")
