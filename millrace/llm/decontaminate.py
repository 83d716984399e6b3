"""Benchmark decontamination by one Aho-Corasick automaton over normalised item windows.

Text is normalised byte by byte (A-Z lower-cased, every other ASCII byte that is neither letter nor
digit becomes a space), so a place in the normalised text is a place in the original.  The windows
of all items, framed by spaces, are the patterns; a document is scanned once.

The items are broadcast as texts in blocks of at most ``block_bytes``, whose sizes are measured
first, and compiled once per worker.  Normally there is one block; a larger item set takes one scan
per block and the hits are carried along, so no item is left out.

Definitions for odd input: NULL text, of a document or an item, has no words; an item of fewer
words than a window is one window; words found several times count once per place; repeated rows
are reported one by one; an item id on several rows is one item; an empty table gives no rows, an
empty item table no hits.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import per_process, slices, table

WINDOW = 10
BLOCK_BYTES = 16 << 20
ALNUM = {*range(48, 58), *range(97, 123), *range(128, 256)}
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b in ALNUM else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
HITS = "array<struct<item:string,first:int,last:int>>"
FOUND = (
    "n_words long, n_hit long, items array<string>, "
    "spans array<struct<start:int,end:int>>, items_sha256 string"
)


def normal_bytes(text: str | None) -> bytes:
    """As long as the UTF-8 of the text, words kept, all else spaces."""
    return (text or "").encode("utf-8", "replace").translate(NORMAL)


def automaton(items: tuple[tuple[str, str | None], ...], window: int):
    """Framed window -> (word count, item ids); None without windows."""
    windows: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = normal_bytes(text).decode("utf-8", "replace").split(" ")
        words = [w for w in words if w]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            windows.setdefault(f" {' '.join(part)} ", (len(part), set()))[1].add(item)
    if not windows:
        return None
    auto = ahocorasick.Automaton()
    for text, found in windows.items():
        auto.add_word(text, found)
    auto.make_automaton()
    return auto


def find(auto, words: list[bytes]) -> list[tuple[str, int, int]]:
    """(item, first word, last word) of each maximal run of an item's windows."""
    if auto is None or not words:
        return []
    text = f" {b' '.join(words).decode('utf-8', 'replace')} "
    ends = [*auto.iter(text)]
    if not ends:
        return []
    frames = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) == 32)
    runs: dict[str, list[list[int]]] = {}
    for end, (n, items) in ends:
        last = int(np.searchsorted(frames, end)) - 1
        for item in items:
            own = runs.setdefault(item, [])
            if own and last - n <= own[-1][1]:
                own[-1] = [min(own[-1][0], last - n + 1), max(own[-1][1], last)]
            else:
                own.append([last - n + 1, last])
    return [(item, a, b) for item in sorted(runs) for a, b in runs[item]]


def places(text: str | None, hits: list[tuple[str, int, int]]) -> tuple[int, list[dict[str, int]]]:
    """Words hit, and the runs of hit words as code point ranges of the original text."""
    runs: list[list[int]] = []
    for _, a, b in sorted(hits, key=lambda h: (h[1], h[2])):
        if runs and a <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    raw = (text or "").encode("utf-8", "replace")
    at = [m.span() for m in WORD.finditer(raw.translate(NORMAL))]
    length = lambda n: len(raw[:n].decode("utf-8", "replace"))
    spans = [{"start": length(at[a][0]), "end": length(at[b][1])} for a, b in runs]
    return sum(b - a + 1 for a, b in runs), spans


def scan(
    docs: DataFrame,
    items: DataFrame,
    *,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` and n_words, n_hit, items, spans (code points of the original), items_sha256."""
    spark = docs.sparkSession
    wanted = items.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"),
        F.col(f"`{item_text}`").cast("string").alias("text"),
    )
    size = wanted.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    frame = docs.select(
        *(F.col(f"`{k}`") for k in keep),
        F.col(f"`{text}`").cast("string").alias("__text"),
        F.lit(None).cast(HITS).alias("__hits"),
    )
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-2])
    for block in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(tuple(sorted(((r.id, r.text) for r in own.collect()), key=str)))
        work = _task(shared, window, len(keep), [*keep], block == blocks - 1)
        frame = frame.mapInArrow(work, kept + (FOUND if block == blocks - 1 else f"__text string, __hits {HITS}"))
    return frame


def _task(shared, window: int, kept: int, names: list[str], last: bool):
    label = uuid.uuid4().hex
    hit_type = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = per_process(("automaton", label), lambda: automaton(shared.value, window))
        for piece in slices(batches, "__text"):
            columns = [piece.column(i) for i in range(kept)]
            rows = []
            for text, before in zip(piece.column("__text").to_pylist(), piece.column("__hits").to_pylist(), strict=True):
                words = normal_bytes(text).split()
                hits = [(h["item"], h["first"], h["last"]) for h in before or ()] + find(auto, words)
                if not last:
                    rows.append([{"item": i, "first": a, "last": b} for i, a, b in hits])
                    continue
                n_hit, spans = places(text, hits) if hits else (0, [])
                found = sorted({h[0] for h in hits})
                rows.append((len(words), n_hit, found, spans, hashlib.sha256(",".join(found).encode()).hexdigest()))
            if last:
                types = (pa.int64(), pa.int64(), pa.list_(pa.string()), span_type, pa.string())
                made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *made], [*names, "n_words", "n_hit", "items", "spans", "items_sha256"]
                )
            else:
                made = [piece.column("__text"), pa.array(rows, hit_type)]
                yield pa.RecordBatch.from_arrays([*columns, *made], [*names, "__text", "__hits"])

    return work


def digests(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    return scan(docs, items, **options).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
