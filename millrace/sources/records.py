"""Records over line breaks, read by many tasks: CSV with quoted line breaks, JSON arrays of objects.

Spark's text source deals a file out in splits and cuts it at a separator: at line feeds for CSV, at
``}`` for JSON.  Whether such a piece ends a record depends on all text before it, but only
through a small state: inside a quoted value or not; inside a string or not, and how deep.  So each split is
read once for **every** possible state at its start, which gives a function from the state before it to
the state after it; the functions of a file's splits are combined in order, and from then on every split
knows how it begins.  A second scan cuts records at their true ends.  Records that cross splits come out in
parts, at most two per split, and are put together by file and place.

What is gathered is one row per split (800,000 rows of some 40 bytes for 100 TB); records are never shuffled
but for those parts.  Reading costs two scans when the frame is made and one per use, on all cores
instead of one per file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
PIECES = "file bigint, block bigint, first string, exits array<int>, depths array<bigint>"
STATES = "file bigint, block bigint, inside int, depth bigint, base int"
RECORDS = "file bigint, block bigint, part int, head boolean, value string"
WHOLE, HEAD, TAIL = -1, 0, 1  # a whole record, the rest of one, the beginning of one
BATCH_BYTES = 8 << 20


class Csv:
    """Delimited text: the state is whether a quoted value is open.  A doubled quote is a quote."""

    separator = "\n"

    def __init__(self, sep: str = ","):
        self.sep, self.opening = sep, sep + '"'

    def step(self, piece: str, inside: int) -> tuple[int, int]:
        """(inside, 0) behind ``piece``.  A quote opens a value only where a field begins."""
        if '"' not in piece:
            return inside, 0
        at = 0
        if not inside:
            if piece.startswith('"'):
                at = 1
            elif (found := piece.find(self.opening)) >= 0:
                at = found + len(self.opening)
            else:
                return 0, 0
        while True:  # at is inside a quoted value
            quote = piece.find('"', at)
            if quote < 0:
                return 1, 0
            if piece.startswith('"', quote + 1):
                at = quote + 2
                continue
            field = piece.find(self.sep, quote + 1)
            if field < 0:
                return 0, 0
            if not piece.startswith(self.opening, field):
                field = piece.find(self.opening, field)
                if field < 0:
                    return 0, 0
            at = field + len(self.opening)

    def ends(self, inside: int, depth: int, base: int) -> bool:
        return not inside

    def opens(self, inside: int, depth: int, base: int) -> bool:
        return bool(inside)

    def record(self, text: str) -> str | None:
        return text.removesuffix("\r")

    def check(self, inside: int, depth: int, base: int) -> None:
        """An open quote at the end is left to the reader of the record."""


class Json:
    """JSON: the state is whether a string is open, and the depth of braces and brackets.

    A file that begins with ``[`` is an array of objects, any other is objects one after the other.
    """

    separator = "}"

    def step(self, piece: str, inside: int) -> tuple[int, int]:
        if inside:
            rest = REST_OF_STRING.match(piece)
            if not rest:
                return 1, 0
            piece = piece[rest.end() :]
        bare = STRING.sub("", piece)
        quote = bare.find('"')
        if quote >= 0:
            bare = bare[:quote]
        depth = bare.count("{") + bare.count("[") - bare.count("]")
        return (1, depth) if quote >= 0 else (0, depth - 1)

    def ends(self, inside: int, depth: int, base: int) -> bool:
        return not inside and depth <= base

    def opens(self, inside: int, depth: int, base: int) -> bool:
        return bool(inside) or depth > base

    def check(self, inside: int, depth: int, base: int) -> None:
        # behind the last ``]`` there is no brace, but one is counted
        if inside or base and depth != -1:
            raise ValueError("a JSON array is not closed")

    def record(self, text: str) -> str | None:
        text = text.lstrip("﻿ \t\r\n,[")
        if text.startswith("{"):
            return text + "}"
        if text.strip(" \t\r\n,]"):
            raise ValueError(f"not an array of JSON objects, found: {text[:80]}")
        return None


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, list[str], pa.RecordBatch]]:
    """(file, block, values, batch) of stretches from one split."""
    for batch in batches:
        files, blocks, values = (batch.column(i).to_pylist() for i in range(3))
        start = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or files[i] != files[start] or blocks[i] != blocks[start]:
                yield files[start], blocks[start], values[start:i], batch.slice(start, 1)
                start = i


def states(spark: SparkSession, path: str, kind: Csv | Json) -> DataFrame:
    """``(file, block, inside, depth, base)``: how each split begins."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, exits, depths, first = None, [0, 1], [0, 0], ""

        def row() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            values = (*now, first, exits, depths)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["file", "block", "first", "exits", "depths"])

        for file, block, values, _ in _runs(batches):
            if now != (file, block):
                if now:
                    yield row()
                now, exits, depths, first = (file, block), [0, 1], [0, 0], ""
            for value in values:
                if not first:
                    first = value.lstrip("﻿ \t\r\n")[:1]
                same = exits[0] == exits[1]  # from then on both go the same way
                exits[0], change = kind.step(value, exits[0])
                exits[1], other = (exits[0], change) if same else kind.step(value, exits[1])
                depths = [depths[0] + change, depths[1] + other]
        if now:
            yield row()

    found = _pieces(spark, path, kind.separator).mapInArrow(scan, PIECES).collect()
    starts, file = [], None
    for r in sorted(found, key=lambda r: (r.file, r.block)):
        if r.file != file:
            if file is not None:
                kind.check(inside, depth, base)
            file, inside, depth, base = r.file, 0, 0, int(r.first == "[")
        starts.append((r.file, r.block, inside, depth, base))
        inside, depth = r.exits[inside], depth + r.depths[inside]
    if file is not None:
        kind.check(inside, depth, base)
    return spark.createDataFrame(starts, STATES)


def records(spark: SparkSession, path: str, kind: Csv | Json) -> DataFrame:
    """``(head, value)``: the text of every record, and whether it is the first of its file."""
    begins = F.broadcast(states(spark, path, kind))  # one row per split
    pieces = _pieces(spark, path, kind.separator).join(begins, ["file", "block"], "left")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "part", "head", "value"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        now, out, size, text = None, [], 0, []
        inside = depth = base = part = 0
        head = False

        def add() -> None:
            nonlocal size, part, head
            value = kind.separator.join(text)
            size += len(value)
            if part == WHOLE:
                value = kind.record(value)
            if value is not None:
                out.append((*now, part, head, value))
            text.clear()
            part, head = WHOLE, False

        def batch() -> pa.RecordBatch:
            columns = [*zip(*out, strict=True)] if out else [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for file, block, values, row in _runs(batches):
            if now != (file, block):
                if text:
                    part = TAIL if part == WHOLE else part
                    add()
                now = file, block
                inside, depth, base = (row.column(i)[0].as_py() for i in (3, 4, 5))
                if inside is None:
                    raise RuntimeError("the splits of the input changed while it was read")
                part = HEAD if kind.opens(inside, depth, base) else WHOLE
                head = block == 0  # of a file
            for value in values:
                inside, change = kind.step(value, inside)
                depth += change
                text.append(value)
                if kind.ends(inside, depth, base):
                    add()
                    if size > BATCH_BYTES:
                        yield batch()
                        size = 0
        if text:
            part = TAIL if part == WHOLE else part
            add()
        if out:
            yield batch()

    found = pieces.select("file", "block", "value", "inside", "depth", "base").mapInArrow(cut, RECORDS)
    # Parts follow each other by split; a tail begins a record, and each head before the next tail goes on with it.
    order = Window.partitionBy("file").orderBy("block", "part")
    parts = found.where(F.col("part") != WHOLE).withColumn("number", F.sum((F.col("part") == TAIL).cast("long")).over(order))
    joined = parts.groupBy("file", "number").agg(
        F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("block", "part", "value"))).alias("all")
    )

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [kind.record(kind.separator.join(p["value"] for p in x)) for x in batch.column(1).to_pylist()]
            kept = [i for i, v in enumerate(made) if v is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([made[i] for i in kept], pa.string())], ["head", "value"])

    crossing = joined.select("head", "all").mapInArrow(close, "head boolean, value string")
    return found.where(F.col("part") == WHOLE).select("head", "value").unionAll(crossing)


def as_strings(df: DataFrame):
    """The one text column as the JVM's dataset of strings, which its readers take."""
    encoder = df.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
    return getattr(df._jdf, "as")(encoder)
