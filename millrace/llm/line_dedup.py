"""Reversible line deduplication: sharded cuckoo filters over exact reference tables.

``LineIndex`` keeps, in a folder all executors share, one version per change (older ones stay usable):

* ``refs``    one row per line key and document that holds it (128-bit digests, no text),
* ``counts``  per key the exact number of references and the smallest and largest document,
* ``filters`` per shard of the key space a cuckoo filter of the keys that two or more documents hold.

Inserting a batch adds its references and counts, and puts the keys that became shared into the
filters of their shards.  Deleting documents takes their references back, recounts only the keys
they held, and deletes keys that are no longer shared from the filters.  A filter that overflows
is built anew from the exact table with twice the room.

Cleaning scans the texts once against the filters, so that only lines that may be shared are
shuffled; the exact table then decides, and the text is joined with its own drops.  The filters are
broadcast only up to ``FILTER_BYTES`` in all, which is measured; beyond that every line goes to the
exact table.  A key that a third of all documents hold is one row after map-side aggregation; its
lines meet it in a join whose large partitions adaptive execution splits.

Definitions for odd input: NULL or empty text is one empty line; a key is the stripped, A-Z
lower-cased line; keys under ``MIN_CHARS`` code points are never dropped; a document keeps all its
copies of a line if it is the smallest id that holds it; rows that repeat an id are one document; a
document without id holds no references and keeps its lines; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import ascii_lower, slices, table
from millrace.session import scratch_path

MIN_CHARS = 10
SHARD_KEYS = 250_000
FILTER_BYTES = 64 << 20
SLOTS, KICKS = 4, 500
SPACE = " \t\n\x0b\x0c\r"
LINE = "hi long, lo long"
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def line_key(line: str) -> bytes | None:
    key = ascii_lower(line.strip(SPACE))
    return hashlib.blake2b(key.encode("utf-8", "replace"), digest_size=16).digest() if len(key) >= MIN_CHARS else None


def keys_of(text: str | None) -> list[bytes | None]:
    return [*map(line_key, (text or "").split("\n"))]


def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Cuckoo:
    """Buckets of four 16-bit fingerprints; 0 is an empty slot."""

    def __init__(self, capacity: int, cells: bytes | None = None):
        n = 4
        while n * SLOTS * 0.8 < capacity:
            n *= 2
        self.cells = np.zeros((n, SLOTS), np.uint16) if cells is None else np.frombuffer(cells, np.uint16).reshape(-1, SLOTS).copy()

    def spots(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.cells) - 1)
        mark = (hi.astype(np.uint64) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        first = ((lo.astype(np.uint64) * M1) >> np.uint64(32)) & mask
        return mark.astype(np.uint16), first.astype(np.int64), self.other(first, mark)

    def other(self, spot, mark) -> np.ndarray:
        jump = (np.asarray(mark, np.uint64) * M2) >> np.uint64(32)
        return ((np.asarray(spot, np.uint64) ^ jump) & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, a, b = self.spots(hi, lo)
        return ((self.cells[a] == mark[:, None]) | (self.cells[b] == mark[:, None])).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if there was no room; the filter must then be built anew."""
        for mark, a, b in zip(*(x.tolist() for x in self.spots(hi, lo)), strict=True):
            if self._put(mark, a) or self._put(mark, b):
                continue
            spot = b
            for kick in range(KICKS):
                slot = (mark + kick) % SLOTS
                mark, self.cells[spot, slot] = int(self.cells[spot, slot]), mark
                spot = int(self.other(spot, mark))
                if self._put(mark, spot):
                    break
            else:
                return False
        return True

    def _put(self, mark: int, spot: int) -> bool:
        row = self.cells[spot]
        for slot in range(SLOTS):
            if not row[slot]:
                row[slot] = mark
                return True
        return False

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for mark, a, b in zip(*(x.tolist() for x in self.spots(hi, lo)), strict=True):
            for spot in (a, b):
                at = np.flatnonzero(self.cells[spot] == mark)
                if len(at):
                    self.cells[spot, at[0]] = 0
                    break


def references(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(hi, lo, doc_id): each line key of each document once per row."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            keys, ids = [], []
            for doc, t in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                own = {k for k in keys_of(t) if k}
                keys += own
                ids += [doc] * len(own)
            hi, lo = halves(keys)
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(ids, pa.int64())], ["hi", "lo", "doc_id"])

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.where("doc_id is not null and text is not null").mapInArrow(work, LINE + ", doc_id long")


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("hi", "lo").agg(
        F.sum("refs").alias("refs"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc")
    )


def _counts(refs: DataFrame) -> DataFrame:
    one = refs.select("hi", "lo", F.lit(1).cast("long").alias("refs"), F.col("doc_id").alias("first_doc"), F.col("doc_id").alias("last_doc"))
    return _summed(one)


def _shared(counts: DataFrame) -> DataFrame:
    return counts.where("first_doc < last_doc")


class LineIndex:
    """One version of the index; every change writes the next one and returns it."""

    def __init__(self, spark: SparkSession, path: str, shards: int):
        self.spark, self.path, self.shards, self.version = spark, path, shards, uuid.uuid4().hex

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version}/{name}")

    @property
    def refs(self) -> DataFrame:
        return self._read("refs")

    @property
    def counts(self) -> DataFrame:
        return self._read("counts")

    @property
    def filters(self) -> DataFrame:
        return self._read("filters")

    def shared(self) -> DataFrame:
        return _shared(self.counts)

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, **columns: str) -> LineIndex:
        """Version 0 from a first batch."""
        spark = docs.sparkSession
        index = cls(spark, path or scratch_path(spark, "line-index"), 1)
        index._write("refs", references(docs, **columns))
        index._write("counts", _counts(index.refs))
        index.shards = max(1, -(-index.shared().count() // SHARD_KEYS))
        index._write("filters", index._filters(index.shared().select("hi", "lo", F.lit(1).alias("change")), None))
        return index

    def insert(self, docs: DataFrame, **columns: str) -> LineIndex:
        after = LineIndex(self.spark, self.path, self.shards)
        new = references(docs, **columns)
        after._write("refs", self.refs.unionByName(new))
        own = _counts(new)
        after._write("counts", _summed(self.counts.unionByName(own)))
        return self._moved(after)

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """Without the documents of ``ids``; their lines count no longer."""
        after = LineIndex(self.spark, self.path, self.shards)
        gone = ids.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id")).distinct()
        touched = self.refs.join(gone, "doc_id", "left_semi").select("hi", "lo").distinct()
        after._write("refs", self.refs.join(gone, "doc_id", "left_anti").select("hi", "lo", "doc_id"))
        again = _counts(after.refs.join(touched, ["hi", "lo"], "left_semi"))
        after._write("counts", self.counts.join(touched, ["hi", "lo"], "left_anti").unionByName(again))
        return self._moved(after)

    def _moved(self, after: LineIndex) -> LineIndex:
        """The filters of ``after``: these, with what became shared and without what no longer is."""
        old, new = self.shared().select("hi", "lo"), after.shared().select("hi", "lo")
        change = new.join(old, ["hi", "lo"], "left_anti").withColumn("change", F.lit(1)).unionByName(
            old.join(new, ["hi", "lo"], "left_anti").withColumn("change", F.lit(-1))
        )
        filters = self._filters(change, self.filters)
        after._write("filters", filters)
        full = after.filters.where("cells is null").select("shard")
        if full.isEmpty():
            return after
        return after._rebuilt()

    def _rebuilt(self) -> LineIndex:
        after = LineIndex(self.spark, self.path, max(1, -(-self.shared().count() // SHARD_KEYS)))
        for name in ("refs", "counts"):
            after._write(name, self._read(name))
        after._write("filters", after._filters(after.shared().select("hi", "lo", F.lit(1).alias("change")), None))
        return after

    def _write(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/{self.version}/{name}")

    def _filters(self, change: DataFrame, before: DataFrame | None) -> DataFrame:
        """(shard, cells); NULL cells where an existing filter has no room left."""
        keyed = change.withColumn("shard", F.pmod("lo", F.lit(self.shards)).cast("int"))
        schema = "shard int, cells binary"
        if before is None:

            def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
                hi, lo, room = rows["hi"].to_numpy(), rows["lo"].to_numpy(), len(rows)
                while not (made := Cuckoo(room)).insert(hi, lo):
                    room *= 2
                return pd.DataFrame({"shard": [key[0]], "cells": [made.cells.tobytes()]})

            return keyed.groupBy("shard").applyInPandas(build, schema)

        def alter(key: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            made = Cuckoo(len(rows), bytes(old["cells"].iloc[0]) if len(old) else None)
            for sign, step in ((-1, made.delete), (1, made.insert)):
                own = rows[rows["change"] == sign]
                if step(own["hi"].to_numpy(), own["lo"].to_numpy()) is False:
                    return pd.DataFrame({"shard": [key[0]], "cells": [None]})
            return pd.DataFrame({"shard": [key[0]], "cells": [made.cells.tobytes()]})

        return before.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(alter, schema)

    def suspects(self, docs: DataFrame) -> DataFrame:
        """(hi, lo, doc_id) of the lines that the filters take for shared."""
        refs = docs
        size = self.filters.agg(F.sum(F.octet_length("cells"))).first()[0] or 0
        if size > FILTER_BYTES:
            return refs
        shared = self.spark.sparkContext.broadcast({r.shard: bytes(r.cells) for r in self.filters.collect()})
        shards = self.shards

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: Cuckoo(0, cells) for s, cells in shared.value.items()}
            for batch in batches:
                hi, lo = batch.column("hi").to_numpy(), batch.column("lo").to_numpy()
                keep, own = np.zeros(len(hi), bool), np.mod(lo, shards)
                for shard, cuckoo in filters.items():
                    at = np.flatnonzero(own == shard)
                    keep[at] = cuckoo.has(hi[at], lo[at])
                yield batch.filter(pa.array(keep))

        return refs.mapInArrow(work, LINE + ", doc_id long")

    def drops(self, refs: DataFrame) -> DataFrame:
        """(doc_id, drop): the packed keys of the lines that each document loses."""
        lost = (
            self.suspects(refs)
            .join(self.shared().select("hi", "lo", "first_doc"), ["hi", "lo"])
            .where("first_doc < doc_id")
        )
        return lost.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set(F.struct("hi", "lo")).alias("__drop"))

    def clean(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", refs: DataFrame | None = None) -> DataFrame:
        """``docs`` with the dropped lines gone, and n_lines (before), n_dropped, kept_sha256.

        ``refs`` may hold the documents' references if they are stored already.
        """
        drops = self.drops(references(docs, doc_id, text) if refs is None else refs)
        made_here = ("n_lines", "n_dropped", "kept_sha256")  # columns of these names are replaced
        docs = docs.drop(*(c for c in docs.columns if c.lower() in made_here))
        names = docs.columns
        frame = docs.select(*(f"`{c}`" for c in names), F.col(f"`{doc_id}`").cast("long").alias("__id"))
        frame = frame.join(drops, F.col("__id") == F.col("__doc"), "left").drop("__id", "__doc")
        at, width = names.index(text), len(names)

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, text):
                kept, n_lines, n_dropped, sha = [], [], [], []
                for t, drop in zip(piece.column(text).to_pylist(), piece.column("__drop").to_pylist(), strict=True):
                    gone = {int(d["hi"]).to_bytes(8, "little", signed=True) + int(d["lo"]).to_bytes(8, "little", signed=True) for d in drop or ()}
                    lines = (t or "").split("\n")
                    left = [x for x in lines if line_key(x) not in gone] if gone else lines
                    kept.append(t if len(left) == len(lines) else "\n".join(left))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(left))
                    sha.append(hashlib.sha256((kept[-1] or "").encode("utf-8", "replace")).hexdigest())
                columns = [pa.array(kept, pa.string()) if i == at else piece.column(i) for i in range(width)]
                made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha)]
                yield pa.RecordBatch.from_arrays([*columns, *made], [*names, "n_lines", "n_dropped", "kept_sha256"])

        types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
        return frame.mapInArrow(work, types + "n_lines long, n_dropped long, kept_sha256 string")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Index and clean the same documents."""
    index = LineIndex.build(docs, doc_id=doc_id, text=text)
    return index.clean(docs, doc_id, text, index.refs)


ORACLE = r"""
with lines as (
  select doc_id, i, line, lower_ascii as key, length(lower_ascii) as n from (
    select doc_id, i, line,
      translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii
    from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents))
), owner as (
  select key, min(doc_id) as first_doc from lines where n >= 10 group by key having count(distinct doc_id) > 1
), judged as (
  select l.doc_id, l.i, l.line, coalesce(o.first_doc < l.doc_id, false) as gone
  from lines l left join owner o on l.key = o.key and l.n >= 10
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
