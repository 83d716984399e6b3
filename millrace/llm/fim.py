"""Fill-in-middle transformation over seekable compressed frames.

``frames`` stores a text as independent zstandard frames of about ``FRAME_BYTES``, cut between units
only, each with the number of units before it.  A unit is a run of white space with the word behind
it, or white space at the end.  ``transform`` draws two cuts and the form from a hash of the id,
decompresses only the frames that hold a cut, and moves all others as they are: the result is again a
list of independent frames, and their concatenation is one valid zstandard stream.  ``restore`` finds
the marks in such a list by streaming it once, and then streams the three parts in their first order.
``digests`` streams frames in order and never holds a whole output.

Rows are worked on where they are, without a shuffle; the frames are written once to the shared
folder, so a lost executor costs the reading of its rows only.  A task holds the compressed frames of
about ``SLICE_BYTES`` of text, or of one longer text, and one plain frame at a time.

Definitions for odd input: NULL text is the empty text, which is always plain and has no frames; texts that
hold a mark are plain; a NULL id is hashed as the empty text; rows are handled one by one, so repeated
rows, and rows that repeat an id, give the same cuts; very long texts have many frames, a very long
word lies in one frame; an empty table gives an empty table.  Only the named columns are read and they
travel under numbers, so extra columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import SLICE_BYTES, WORD_SPACE, give_back, slices, stored, table

FRAME_BYTES = 64 << 10
LEVEL = 3
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PARTS = ("prefix", "middle", "suffix")
FRAMES = "units long, marked boolean, frames array<struct<units:bigint,data:binary>>"
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
GAP = re.compile(rb"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")  # a unit ends behind it
FRAME_TYPE = pa.list_(pa.struct([("units", pa.int64()), ("data", pa.binary())]))


def pieces(text: bytes, size: int = FRAME_BYTES) -> Iterator[tuple[int, bytes]]:
    """(units, text) of the stretches that become frames; each ends where a unit ends."""
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + size - 1) if len(text) - start > size else None
        part = text[start : gap.end()] if gap else text[start:]
        start += len(part)
        # bytes.split knows just the white space of a unit
        yield len(part.split()) + (start == len(text) and part[-1:].isspace()), part


def _numbered(df: DataFrame, keep: tuple[str, ...]) -> list[Column]:
    return [F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(keep)]


def _types(df: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f"k{i} {df.select(f'`{n}`').schema[0].dataType.simpleString()}, " for i, n in enumerate(keep))


def frames(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = FRAME_BYTES) -> DataFrame:
    """``keep``, ``units``, ``marked`` (a mark is in the text) and ``frames`` of every text."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = F.lit(False)
    for mark in MARKS.values():
        marked = marked | F.contains(value, F.lit(mark))
    source = df.select(*_numbered(df, keep), marked.alias("marked"), value.alias("value"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        for piece in slices(batches, "value"):
            sizes, units, before, data = [0], [], [], []
            for value in piece.column("value"):
                n = 0
                for count, part in pieces(value.as_buffer().to_pybytes(), size):
                    before.append(n)
                    data.append(press(part))
                    n += count
                units.append(n)
                sizes.append(len(data))
            parts = pa.StructArray.from_arrays([pa.array(before, pa.int64()), pa.array(data, pa.binary())], ["units", "data"])
            kept = [piece.column(i) for i in range(len(keep))]
            made = [pa.array(units, pa.int64()), piece.column("marked"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), parts, type=FRAME_TYPE)]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*names, "units", "marked", "frames"])

    names = [f"k{i}" for i in range(len(keep))]
    return source.mapInArrow(work, _types(df, keep) + FRAMES).toDF(*keep, "units", "marked", "frames")


def draws(key: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of a hash, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def planned(framed: DataFrame, key: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``framed`` with ``form``, and ``first`` and ``second``, the units before the two cuts.

    Of 100 texts about ``rate`` are transformed, of 100 of those about ``spm`` to suffix first.
    """
    h1, h2, h3, h4 = draws(F.col(f"`{key}`"), seed)
    plain = (F.col("units") == 0) | F.col("marked") | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    ends = F.col("units") + 1
    return framed.withColumns({"form": form, "first": F.least(h1 % ends, h2 % ends), "second": F.greatest(h1 % ends, h2 % ends)})


def find(unit: int, before: list[int], data: list[bytes], plain: Callable[[bytes], bytes]) -> tuple[int, int]:
    """(frame, byte in its text) of the cut behind ``unit`` units; one frame is decompressed."""
    if not unit:
        return 0, 0
    at = bisect_left(before, unit) - 1
    found = next(islice(UNIT.finditer(plain(data[at])), unit - before[at] - 1, None))
    return at, found.end()


def stretch(start: tuple[int, int], end: tuple[int, int], data: list[bytes], plain, press) -> Iterator[bytes]:
    """The frames of the text between two places; whole frames are passed on as they are."""
    (a, i), (b, j) = start, end
    if a == b:
        part = plain(data[a])[i:j]
        return iter([press(part)] if part else [])
    rest = plain(data[a])[i:] if i else b""
    head = [data[a]] if not i else [press(rest)] if rest else []
    tail = [press(plain(data[b])[:j])] if j else []
    return iter([*head, *data[a + 1 : b], *tail])


def transform(planned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``units``, ``form``, ``prefix_chars``, ``middle_chars`` and the output as ``frames``."""
    source = planned.select(*_numbered(planned, keep), "units", "form", "first", "second", "frames")
    names = [f"k{i}" for i in range(len(keep))]
    made = ("units", "form", "prefix_chars", "middle_chars", "frames")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, plain = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
        mark = {k: press(v.encode()) for k, v in MARKS.items()}

        def length(some: Iterable[bytes]) -> int:
            return sum(len(plain(x).decode()) for x in some)

        for batch in batches:
            for piece in in_pieces(batch, "frames"):
                rows = []
                for form, first, second, stored in zip(*(piece.column(n).to_pylist() for n in ("form", "first", "second", "frames")), strict=True):
                    data = [f["data"] for f in stored]
                    if form == "plain":
                        rows.append((None, None, data))
                        continue
                    before = [f["units"] for f in stored]
                    cuts = [(0, 0), find(first, before, data, plain), find(second, before, data, plain), (len(data), 0)]
                    part = {name: [*stretch(a, b, data, plain, press)] for name, a, b in zip(PARTS, cuts, cuts[1:], strict=False)}
                    out = [x for name in ORDERS[form] for x in (mark[name], *part[name])]
                    rows.append((length(part["prefix"]), length(part["middle"]), out))
                prefix, middle, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(i) for i in range(len(keep))), piece.column("units"), piece.column("form"),
                        pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.list_(pa.binary())),
                    ],
                    [*names, *made],
                )
        give_back()

    types = "units long, form string, prefix_chars long, middle_chars long, frames array<binary>"
    return source.mapInArrow(work, _types(planned, keep) + types).toDF(*keep, *made)


def in_pieces(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that a piece's lists hold about ``most`` bytes, or one row."""
    sizes = [batch.column(column).slice(i, 1).nbytes for i in range(batch.num_rows)] if batch.nbytes > most else []
    if not sizes:
        if batch.num_rows:
            yield batch
        return
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def text_of(frames: Iterable[bytes]) -> Iterator[bytes]:
    plain = zstandard.ZstdDecompressor().decompress
    return map(plain, frames)


def marks_in(frames: list[bytes], marks: list[bytes], plain) -> tuple[list[int], list[int]]:
    """Where each frame begins in the output, and where the marks stand, looked for in this order."""
    starts, places, rest, at = [0], [], b"", 0
    for frame in frames:
        text = rest + plain(frame)
        base, low = at - len(rest), 0
        while len(places) < len(marks) and (found := text.find(marks[len(places)], low)) >= 0:
            places.append(base + found)
            low = found + len(marks[0])
        at = base + len(text)
        starts.append(at)
        rest = text[max(low, len(text) - len(marks[0]) + 1) :]
    return starts, places


def restore(form: str, frames: list[bytes], plain: Callable[[bytes], bytes]) -> Iterator[bytes]:
    """The text that an output was made of, piece by piece, read from the output and its form."""
    if form == "plain":
        yield from map(plain, frames)
        return
    order = ORDERS[form]
    starts, places = marks_in(frames, [MARKS[name].encode() for name in order], plain)
    size = len(MARKS["prefix"])
    ends = [*places[1:], starts[-1]]
    spans = {name: (a + size, b) for name, a, b in zip(order, places, ends, strict=True)}
    for name in PARTS:
        low, high = spans[name]
        at = bisect_right(starts, low) - 1
        while low < high:
            text = plain(frames[at])[low - starts[at] : high - starts[at]]
            yield text
            low += len(text)
            at += 1


def digests(made: DataFrame, keep: tuple[str, ...] = ("doc_id", "units", "form", "prefix_chars", "middle_chars")) -> DataFrame:
    """``keep``, ``output_sha256`` and ``restored_sha256``, by streaming the frames in order."""
    source = made.select(*_numbered(made, keep), F.col("form").alias("form"), F.col("frames").alias("frames"))
    names = [f"k{i}" for i in range(len(keep))]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress

        def sha(parts: Iterable[bytes]) -> str:
            state = hashlib.sha256()
            for part in parts:
                state.update(part)
            return state.hexdigest()

        for batch in batches:
            out, back = [], []
            for form, frames in zip(batch.column("form"), batch.column("frames"), strict=True):
                form, frames = form.as_py(), frames.as_py()
                out.append(sha(map(plain, frames)))
                back.append(sha(restore(form, frames, plain)))
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.string()), pa.array(back, pa.string())], [*names, "output_sha256", "restored_sha256"])

    return source.mapInArrow(work, _types(made, keep) + "output_sha256 string, restored_sha256 string").toDF(*keep, "output_sha256", "restored_sha256")


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    framed = stored(frames(table(spark, folder, "documents")), "frames")
    return digests(transform(planned(framed))).withColumnRenamed("units", "n")


_UNITS = rf"{WORD_SPACE}*[^\x20\x09-\x0D]+|{WORD_SPACE}+"

ORACLE = rf"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_UNITS}') as w,
    sha256('42:' || doc_id) as s
  from documents
), h as (
  select *, len(w) as n, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2,
    ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from d
), f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50
      then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h
), p as (
  select *, array_to_string(w[1:a], '') as prefix, array_to_string(w[a + 1 : b], '') as middle,
    array_to_string(w[b + 1 :], '') as suffix from f
), o as (
  select *, case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output from p
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars, sha256(output) as output_sha256,
  sha256(case when form = 'plain' then output
    else split_part(split_part(output, '<P>', 2), case form when 'psm' then '<S>' else '<M>' end, 1)
      || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), case form when 'psm' then '<M>' else '<P>' end, 1)
    end) as restored_sha256
from o
"""
