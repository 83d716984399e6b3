"""Value lookups: synonyms and dictionary codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.names import bare
from millrace.session import ensure_checkpoint_dir

LITERAL_ENTRIES = 64  # a map literal is searched entry by entry for each row
BROADCAST_BYTES = 64 * 1024 * 1024
ROW_BYTES = 50  # what a broadcast row costs besides its values


def apply_synonyms(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Lower-case a text column and replace the values named in ``mapping``."""
    if column not in df.columns or not mapping:
        return df
    value = F.lower(bare(column))
    if len(mapping) <= LITERAL_ENTRIES:
        pairs = [F.lit(x) for item in mapping.items() for x in item]
        found = F.try_element_at(F.create_map(*pairs), value)
        return df.withColumn(column, F.coalesce(found, value))
    table = df.sparkSession.createDataFrame(list(mapping.items()), "_from string, _to string")
    size = sum(len(k.encode()) + len(v.encode()) + ROW_BYTES for k, v in mapping.items())
    return _replaced(df, column, table, size)


def apply_synonym_table(
    df: DataFrame, column: str, table: DataFrame, source: str, target: str
) -> DataFrame:
    """The same with the mapping held in a table of any size.

    Keys that agree in lower case are one key; it takes the smallest of their targets.
    """
    slim = table.select(F.lower(bare(source)).alias("_from"), bare(target).alias("_to"))
    slim = slim.where("_from is not null").groupBy("_from").agg(F.min("_to").alias("_to"))
    weight = F.octet_length("_from") + F.coalesce(F.octet_length("_to"), F.lit(0)) + ROW_BYTES
    size = slim.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return _replaced(df, column, slim, size)


def _replaced(df: DataFrame, column: str, table: DataFrame, size: int) -> DataFrame:
    names = df.columns
    side = sized_broadcast(table, size)
    joined = df.withColumn("_value", F.lower(bare(column))).join(
        side, F.col("_value") == F.col("_from"), "left"
    )
    new = F.coalesce("_to", "_value")
    return joined.select(*((new if c == column else bare(c)).alias(c) for c in names))


def sized_broadcast(table: DataFrame, size: int) -> DataFrame:
    """Broadcast a side only if its measured bytes allow it.

    Beyond that the join shuffles; the lookup side is unique per key, so adaptive execution can
    split a hot key's rows over many tasks.
    """
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def number_sorted(values: DataFrame, column: str, name: str) -> tuple[DataFrame, int, int]:
    """Number distinct values 0, 1, 2 … in sort order, on any number of tasks.

    The values are range-partitioned, pinned by a checkpoint, counted per partition, and numbered
    inside each partition from the partition's offset; no task sees them all.  Returns the table
    ``(column, name)``, its row count and its bytes.
    """
    ensure_checkpoint_dir(values.sparkSession)
    pinned = (
        values.repartitionByRange(bare(column))
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    sizes = (
        pinned.groupBy("_part")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.octet_length(bare(column).cast("string"))).alias("bytes"),
        )
        .orderBy("_part")
        .collect()
    )
    rows = sum(r["n"] for r in sizes)
    size = rows * ROW_BYTES + sum(r["bytes"] or 0 for r in sizes)
    starts = [0] * (1 + max((r["_part"] for r in sizes), default=0))
    seen = 0
    for r in sizes:
        starts[r["_part"]] = seen
        seen += r["n"]
    offset = F.get(F.array(*(F.lit(s).cast("long") for s in starts)), F.col("_part"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(bare(column)))
    numbered = pinned.select(bare(column), (offset + place - 1).alias(name))
    return numbered, rows, size


def level_table(df: DataFrame, column: str) -> tuple[DataFrame, int, int]:
    """``(value, code)`` for the distinct non-null values of a column, codes in sorted order."""
    values = df.select(bare(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return number_sorted(values, "value", "code")


def join_codes(
    df: DataFrame,
    column: str,
    levels: DataFrame,
    size: int,
    into: str,
    unseen: int | None = None,
) -> DataFrame:
    """Add a column's codes; values outside the level table get ``unseen``."""
    side = sized_broadcast(levels.select(F.col("value").alias("_v"), F.col("code").alias("_c")), size)
    names = [c for c in df.columns if c != into]
    joined = df.join(side, bare(column) == F.col("_v"), "left")
    code = F.col("_c")
    if unseen is not None:
        code = F.coalesce(code, F.when(bare(column).isNotNull(), F.lit(unseen).cast("long")))
    return joined.select(*(bare(c) for c in names), code.alias(into))


def dictionary_encode(df: DataFrame, columns: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Add a dictionary code next to each column; NULL has no code.

    Spark has no category type; sorted codes are its observable part.
    """
    for column in columns:
        levels, _, size = level_table(df, column)
        df = join_codes(df, column, levels, size, column + suffix)
    return df
