"""Long form: one row per (row, column).

Statistics of many columns are one ``groupBy(column)`` with a fixed set of aggregates.  The plan
stays the same size for 5 or 5,000 columns, is combined map-side to one row per column and task,
and shuffles nothing else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.names import bare

SLOT = "slot"  # position of the column in the list the caller passed


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def number_columns(df: DataFrame, with_bool: bool = False) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if with_bool else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def field(df: DataFrame, name: str) -> T.StructField:
    return next(f for f in df.schema.fields if f.name == name)


def non_null(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL: Spark keeps the two apart, table cleaning does not."""
    col = bare(name)
    if is_float(field(df, name).dataType):
        return F.when(~F.isnan(col), col)
    return col


def as_double(df: DataFrame, name: str) -> Column:
    col = non_null(df, name)
    if isinstance(field(df, name).dataType, T.BooleanType):
        return col.cast("int").cast("double")
    return col.cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if is_float(f.dataType)]
    if not floats:
        return df
    return df.withColumns({n: non_null(df, n) for n in floats})


def melt(df: DataFrame, parts: Sequence[Mapping[str, Column]]) -> DataFrame:
    """One output row per entry of ``parts`` for every input row, with its position as ``slot``."""
    rows = [
        F.struct(F.lit(i).alias(SLOT), *(col.alias(name) for name, col in part.items()))
        for i, part in enumerate(parts)
    ]
    return df.select(F.inline(F.array(*rows)))


def melt_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return melt(df, [{"x": as_double(df, c)} for c in columns])


def named(df: DataFrame, columns: Sequence[str], name: str = "column_name") -> DataFrame:
    """Replace ``slot`` by the column's name."""
    labels = F.array(*(F.lit(c) for c in columns))
    return df.select(
        F.get(labels, F.col(SLOT)).alias(name), *(bare(c) for c in df.columns if c != SLOT)
    )
