"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch_path

WORD_SPACE = r"[\x20\x09-\x0D]"  # what separates words in the contracts
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SLICE_BYTES = 8 << 20  # text handled at once inside a task


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below the shared folder and read back.

    Cuts the lineage with files that every executor reaches, so a lost executor costs no
    recomputation, and each later use is a plain scan.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; NULL counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that one piece holds about ``most`` bytes of text at most.

    A single longer text is a piece of its own.  At the end the worker gives back the memory it no
    longer uses, for it may live on through many tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total + n > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Free memory of Arrow and of the C library back to the system, where they can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def per_process(key: object, make: Callable[[], object], most: int = 1) -> object:
    """``make()`` once per worker process and key; beyond ``most`` the oldest is forgotten.

    A task needs one such thing, and a worker that lives on should not hold those of earlier stages.

    The package travels with each task by value, so a module's own variables would be new every time.
    """
    home = sys.modules.setdefault("_millrace_kept", types.ModuleType("_millrace_kept"))
    kept = home.__dict__.setdefault("kept", {})
    if key not in kept:
        while len(kept) >= most:
            kept.pop(next(iter(kept)))
        kept[key] = make()
    return kept[key]


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
