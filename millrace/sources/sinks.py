"""Storing results: catalog tables and CSV folders."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame


def save_table(
    df: DataFrame,
    name: str = "data",
    path: str | None = None,
    partition_by: tuple[str, ...] = (),
    cluster_by: tuple[int, tuple[str, ...]] | None = None,
    known_filled: bool = False,
) -> str:
    """Store as a table, replacing an older one; an empty frame is refused.

    ``cluster_by=(buckets, columns)`` buckets the table, so later joins on these columns need no
    shuffle.  ``known_filled`` skips the emptiness probe where the row count is already known.
    """
    if not known_filled and df.isEmpty():
        raise ValueError("DataFrame is empty. Cannot save it as a table.")
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if cluster_by:
        buckets, columns = cluster_by
        writer = writer.bucketBy(buckets, *columns).sortBy(*columns)
    writer.saveAsTable(name)
    return name


def cleaned_name(source: str) -> str:
    """``orders.csv`` → ``orders_cleaned.csv``."""
    return f"{PurePosixPath(source).stem}_cleaned.csv"


def write_csv(df: DataFrame, path: str, header: bool = True) -> str:
    """A folder of CSV part files, written in parallel.

    Quotes are doubled rather than escaped by a backslash and blanks at the ends of values stay, so
    that any text survives re-reading.
    """
    writer = df.write.mode("overwrite").option("header", header).option("escape", '"')
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer.options(**blanks).csv(path)
    return path
