"""Dictionary codes that grow with the table: new levels are appended, given codes never change."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import lookup
from millrace.operators.names import bare

SCHEMA = "value string, code bigint"


@dataclass(frozen=True)
class CodeBook:
    """One version of a code table: the Parquet parts it consists of, its rows and its bytes.

    A version is a list of parts, so growing leaves earlier versions readable as they were, and a write
    that fails leaves a folder that no version names.  Versions form a chain: grow the newest one.
    """

    parts: tuple[str, ...] = ()
    rows: int = 0
    size: int = 0

    def table(self, spark: SparkSession) -> DataFrame:
        if not self.parts:
            return spark.createDataFrame([], SCHEMA)
        return spark.read.schema(SCHEMA).parquet(*self.parts)

    def grown(self, df: DataFrame, column: str, folder: str) -> CodeBook:
        """The version that also knows the levels of ``df``; NULL is no level.

        Only levels that no part holds are numbered, in sort order behind the old ones, and written as a part of
        their own below ``folder``.  A batch without new levels gives the same version.
        """
        spark = df.sparkSession
        levels = df.select(bare(column).cast("string").alias("value")).where("value is not null").distinct()
        if self.parts:
            known = lookup.sized_broadcast(self.table(spark).select("value"), self.size)
            levels = levels.join(known, "value", "left_anti")
        fresh, rows, size = lookup.number_sorted(levels, "value", "code")
        if not rows:
            return self
        part = f"{folder.rstrip('/')}/codes-{self.rows}-{uuid.uuid4().hex}"
        fresh.select("value", (F.col("code") + self.rows).alias("code")).write.parquet(part)
        return CodeBook((*self.parts, part), self.rows + rows, self.size + size)

    def encode(self, df: DataFrame, column: str, into: str, unseen: int | None = None) -> DataFrame:
        """``df`` with the codes of a column; values without one get ``unseen``."""
        return lookup.join_codes(df, column, self.table(df.sparkSession), self.size, into, unseen)
