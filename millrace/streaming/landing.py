"""Files arriving in a folder, cleaned with a fitted plan and appended to a table folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.names import bare
from millrace.plans.cleaning import CleaningPlan


def source_schema(plan: CleaningPlan) -> str:
    """The schema the plan was fitted on, as DDL: streams must not infer one."""
    return ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in plan.source)


def read_landing(
    spark: SparkSession, path: str, plan: CleaningPlan, fmt: str = "parquet", **opts
) -> DataFrame:
    return spark.readStream.format(fmt).schema(source_schema(plan)).options(**opts).load(path)


def clean_stream(
    stream: DataFrame,
    plan: CleaningPlan,
    keys: Sequence[str] = (),
    event_time: str | None = None,
    late_by: str = "1 hour",
) -> DataFrame:
    """The plan applied to a stream.

    Everything but de-duplication is stateless.  Copies are dropped only where the caller names
    ``keys`` and an ``event_time`` of the output: the state then covers ``late_by``, not all time.
    """
    out = plan.transform(stream, skip=("dedupe_rows",))
    if not keys:
        return out
    if event_time is None:
        raise ValueError("de-duplicating a stream needs an event_time for its watermark")
    kind = next(f.dataType.simpleString() for f in out.schema.fields if f.name == event_time)
    if kind == "timestamp_ntz":  # watermarks want an instant
        out = out.withColumn(event_time, bare(event_time).cast("timestamp"))
    return out.withWatermark(event_time, late_by).dropDuplicatesWithinWatermark(list(keys))


def write_landing(
    cleaned: DataFrame, path: str, checkpoint: str | None = None, once: bool = True
) -> StreamingQuery:
    """Append to a parquet folder; ``once`` processes what is there and ends.

    The checkpoint makes a restarted query continue where it was, without copies; unless named it
    lies beside the output.
    """
    place = checkpoint or path.rstrip("/") + "_checkpoint"
    writer = cleaned.writeStream.format("parquet").option("checkpointLocation", place)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(path)
