"""The first row per key of a stream, kept in keyed state until no earlier one can come."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from millrace.operators.names import bare

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# fmt: off
ORDERED = (
    T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType,
)
# fmt: on
PLAIN = {"string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp_ntz", "binary"}
SLOTS = 1 << 12  # keys share so many entries of the state
SLOT = "_slot"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While inside, queries start with the state store that keyed state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _rank(value: object) -> tuple:
    """Sorts like Spark: NULL first, NaN after all numbers."""
    if value is None:
        return (0,)
    if isinstance(value, float) and math.isnan(value):
        return (2,)
    return (1, bytes(value) if isinstance(value, bytearray) else value)


class KeepFirst(StatefulProcessor):
    """State of a slot of keys: the first row of each so far with its last event time; a timer ends the next of them.

    Asking the state costs far more than a row does, so a slot's keys are read and written together.
    """

    def __init__(self, names: list[str], keys: list[str], order: list[str], state: T.StructType, keep_ms: int):
        self.names, self.keys, self.order, self.state, self.keep = names, keys, order, state, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", T.StructType([T.StructField("rows", T.ArrayType(self.state))]))
        self.told = Row(*self.names, "late")
        at = {n: i for i, n in enumerate(self.state.names)}
        self.key_at, self.name_at = [at[k] for k in self.keys], [at[n] for n in self.names]
        self.order_at = [at[o] for o in self.order]

    def _row(self, held: tuple, late: bool) -> Row:
        return self.told(*[held[i] for i in self.name_at], late)

    def _place(self, held: tuple) -> list[tuple]:
        return [_rank(held[i]) for i in self.order_at]

    def _read(self) -> dict[tuple, tuple]:
        found = self.first.get() if self.first.exists() else None
        return {tuple(_rank(r[i]) for i in self.key_at): tuple(r) for r in found[0]} if found is not None else {}

    def _closed(self, held: dict[tuple, tuple], mark: int) -> list[tuple]:
        """Take out of ``held`` the rows whose keys end."""
        due = [k for k, r in held.items() if r[-1] + self.keep <= mark]
        return [held.pop(k) for k in due]

    def _write(self, held: dict[tuple, tuple]) -> None:
        if held:
            self.first.update(([*held.values()],))
        else:
            self.first.clear()

    def _next(self, held: dict[tuple, tuple]) -> int | None:
        return min(r[-1] for r in held.values()) + self.keep if held else None

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = self._read()
        timer, changed, taken = self._next(held), False, None
        for row in rows:
            if taken is None:  # the order of the columns that come is the engine's
                taken = [row.__fields__.index(n) for n in (*self.state.names[:-1], "_ms")]
            now = tuple([row[i] for i in taken])
            if now[-1] is None or now[-1] <= mark:
                yield self._row(now, True)
                continue
            own = tuple(_rank(now[i]) for i in self.key_at)
            best = held.get(own)
            if best is None:
                held[own], changed = now, True
                continue
            last = max(best[-1], now[-1])
            if self._place(now) < self._place(best):
                held[own], changed = (*now[:-1], last), True
            elif last != best[-1]:
                held[own], changed = (*best[:-1], last), True
        closed = self._closed(held, mark)
        if not (changed or closed):
            return
        for row in closed:
            yield self._row(row, False)
        self._write(held)
        later = self._next(held)
        if later != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if later is not None:
                self.handle.registerTimer(later)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._read()
        for row in self._closed(held, timerValues.getCurrentWatermarkInMs()):
            yield self._row(row, False)
        self._write(held)
        later = self._next(held)
        if later is not None:
            self.handle.registerTimer(later)

    def close(self) -> None:
        pass


def _plain(kind: T.DataType) -> bool:
    """Whether Python tells values of a type apart as Spark does."""
    return isinstance(kind, T.DecimalType) or kind.simpleString() in PLAIN


def first_by_key(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    event_time: str,
    late_by: str = "1 hour",
    keep_ms: int = 3_600_000,
    slots: int = SLOTS,
) -> DataFrame:
    """The rows of ``stream`` that are first of their key, and those that came too late, marked ``late``.

    First is the smallest by ``order`` and then by all other columns, as ``dedupe_rows`` has it.  A key is
    open until the watermark (the greatest event time less ``late_by``) has passed its last event time by
    ``keep_ms``; then its first row is written and the key is forgotten, so the state covers that time and
    not all time.  The order in which rows arrive plays no part as long as they are not late.

    Rows at or below the watermark, and those without event time, come out at once with ``late`` true; they
    change nothing.  NULL keys are a key.  Keys are dealt by hash into ``slots`` entries of the state, each with the first
    rows of its keys.  A task goes through an entry's new rows one after the other, holds the entry's first rows (4,400 where
    18 million keys are open) and writes them together, so a batch that meets every entry writes the whole state: many
    small batches on a large state want more slots.  A checkpoint is bound to its slots.  Keys of types that Python may
    tell apart otherwise than Spark have an entry each.
    Rows still held can be read with ``open_rows``.
    """
    spark = stream.sparkSession
    if spark.conf.get(PROVIDER) != ROCKS:
        raise ValueError(f"keyed state needs {PROVIDER} = {ROCKS}: see keyed_state()")
    names = stream.columns
    for c in ("late", "_ms", "_last", SLOT):
        if c in names:
            raise ValueError(f"the column name {c!r} is taken")
    lead = {f"_o{i}": bare(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    rest = [c for c in names if c not in keys]
    marked = stream.withColumn("_mark", bare(event_time).cast("timestamp")).withWatermark("_mark", late_by)
    # The stateful step gets the time as a plain number: it would otherwise lose late rows before seeing them.
    given = marked.select(*(bare(c) for c in names), *(c.alias(n) for n, c in lead.items()), F.unix_millis("_mark").alias("_ms"))
    # Instants travel as numbers: Python would read them in a zone that depends on the worker.
    instants = {f.name for f in given.schema.fields if isinstance(f.dataType, T.TimestampType)}
    given = given.select(*(F.unix_micros(bare(c)).alias(c) if c in instants else bare(c) for c in given.columns))
    for f in given.select(*lead, *(bare(c) for c in rest)).schema.fields:
        if not isinstance(f.dataType, ORDERED):
            raise ValueError(f"rows cannot be ordered by {f.name!r} of type {f.dataType.simpleString()}")
    shared = all(_plain(given.schema[k].dataType) for k in keys)
    state = T.StructType([f for f in given.schema.fields if f.name != "_ms"] + [T.StructField("_last", T.LongType())])
    state = T.StructType([T.StructField(f.name, f.dataType) for f in state.fields])
    out = T.StructType([T.StructField(n, given.schema[n].dataType) for n in names] + [T.StructField("late", T.BooleanType())])
    processor = KeepFirst(names, list(keys) if shared else [], [*lead, *rest], state, keep_ms)
    slot = F.pmod(F.xxhash64(*(bare(k) for k in keys)), F.lit(slots)).cast("int")
    dealt = given.withColumn(SLOT, slot).groupBy(SLOT) if shared else given.groupBy(*(bare(k) for k in keys))
    told = dealt.transformWithState(processor, out, "Append", "EventTime")
    return told.select(*(F.timestamp_micros(bare(c)).alias(c) if c in instants else bare(c) for c in names), "late")


def write_keyed(first: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to a Parquet folder, first rows and late ones in parts of their own, and end.

    A restarted query goes on from the checkpoint, without copies.
    """
    writer = first.writeStream.format("parquet").partitionBy("late").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).outputMode("append").start(path)


def open_rows(spark: SparkSession, checkpoint: str, schema: T.StructType) -> DataFrame:
    """The first rows of the keys that are still open, read from the state of a query that has stopped."""
    state = spark.read.format("statestore").option("stateVarName", "first").load(checkpoint)
    state = state.select(F.explode("value.rows").alias("value"))
    held = {f.name: F.col("value").getField(f.name) for f in schema.fields}
    for f in schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            held[f.name] = F.timestamp_micros(held[f.name])
    return state.select(*(c.alias(n) for n, c in held.items()))


def keyed_table(spark: SparkSession, path: str, checkpoint: str, schema: T.StructType) -> DataFrame:
    """First rows and late rows written so far together with the open ones: what the stream has told by now."""
    written = spark.read.schema(T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])).parquet(path)
    held = open_rows(spark, checkpoint, schema)
    return written.unionByName(held.withColumn("late", F.lit(False)))


def step_counts(query: StreamingQuery) -> dict[str, int]:
    """What a query has done, summed over its reported batches: rows read, late, held, and written."""
    done = {"batches": 0, "read": 0, "held": 0}
    for p in query.recentProgress:
        done["batches"] += 1
        done["read"] += p.numInputRows
        done["held"] = sum(s.numRowsTotal for s in p.stateOperators)
        for name, row in (p.observedMetrics or {}).items():
            for k, v in row.asDict().items():
                done[f"{name}.{k}"] = done.get(f"{name}.{k}", 0) + (v or 0)
    return done
