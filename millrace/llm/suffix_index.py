"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

A string of ``LENGTH`` bytes that occurs in a document with a smaller id is removed wherever it occurs
later.  Not every suffix is indexed: of the ``SPAN`` grams of ``GRAM`` bytes inside each such string the
one with the smallest hash is an *anchor*, so two equal strings hold the same anchor at the same place, and
indexing the suffixes that begin at anchors (one byte in thirteen) finds every repeat.

A suffix array here is a run of anchors sorted by gram (32 bits of its hash within a shard of the hash
space), then by a 64-bit hash of the gram and ``REACH`` bytes of context to either side, document and place.  A batch
is sorted once and becomes a level, a folder with one run per shard.  It is merge-scanned against the levels
that are there, which stay where they are; then levels at most ``GROWTH`` times as large as what follows
them are merged with it into a new one, so sizes grow geometrically and each anchor is rewritten a logarithmic number of times.

A merge-scan tells what the batch adds: for each gram of the batch, the anchors that now are

* repeats: a smaller document has the same gram and context, so all strings around the anchor are repeated;
* lookups: several documents have the gram, in other contexts, so repeats may end here.  Of each context the anchors in
  the smallest document are looked up in the texts, by a join on the document, and their ``SPAN`` strings are
  compared by hash within the shard.

What older scans found stays true.  Both give byte ranges; a document's ranges meet its text in a join on the id.
Data moves as one packed row per task and shard or bucket of documents, so a gram in a third of all documents is one
run of numbers among others, never pairs.  A text of any length is scanned in overlapping pieces.

Definitions for odd input: NULL text is the empty text; texts shorter than a string lose nothing; the first
document that holds a string keeps it, however often it repeats there; rows that repeat an id are one
document; a document without id loses nothing and counts for nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import slices, stored, table
from millrace.session import scratch_path

LENGTH, GRAM = 50, 26
SPAN = LENGTH - GRAM + 1  # grams per string; a gram is at least as long, so neighbours' grams touch
REACH = SPAN - 1
CHUNK = 2 << 20  # bytes hashed at once
SHARD_BYTES = 6 << 20  # of text per shard
GROWTH = 2
PROBES = 5
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
TYPES = {"gram": np.uint32, "context": np.uint64, "doc": np.int64, "place": np.uint32}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    w = data.astype(np.uint64)
    w = w[:-1] | (w[1:] << np.uint64(8))
    w = w[:-2] | (w[2:] << np.uint64(16))
    return w[:-4] | (w[4:] << np.uint64(32))


def hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from each place on, given ``eights``."""
    m = max(0, len(w) - (n - 8))
    h = np.zeros(m, np.uint64)
    for at in [*range(0, n - 8, 8), n - 8]:
        h = mixed(h * M1 + w[at : at + m])
    return h


def sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """``best`` of each ``n`` neighbours."""
    k = 1
    while 2 * k <= n:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[: len(x) - (n - k)], x[n - k :]) if k < n else x


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal neighbours."""
    if not len(values):
        return []
    cuts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return [*zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)], strict=True)]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of the texts that end at ``ends``."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hashes(eights(data), GRAM)
    low = sliding(h, SPAN, np.minimum)  # of the strings from each place on
    whole = np.ones(len(low), bool)
    for e in ends[:-1]:
        whole[max(0, e - LENGTH + 1) : e] = False  # strings over the end of a text
    low = np.where(whole, low, np.uint64(0))
    edge = np.zeros(REACH, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate((edge, low, edge)), SPAN, np.maximum) == h)
    return at, h[at]


def pieces(texts: Iterable[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text ends, document ids, place of each text's first byte in its document).

    Long texts come in pieces that overlap so far that every string and its contexts are whole in one.
    """
    data, ends, docs, begins, total = [], [], [], [], 0

    def packed():
        return np.frombuffer(b"".join(data), np.uint8), np.array(ends), np.array(docs, np.int64), np.array(begins, np.int64)

    for doc, text in texts:
        if len(text) < LENGTH:
            continue
        if total and total + len(text) > CHUNK:
            yield packed()
            data, ends, docs, begins, total = [], [], [], [], 0
        step = CHUNK
        for start in range(0, max(1, len(text) - LENGTH + 1), step):
            if start:
                yield packed()
                data, ends, docs, begins, total = [], [], [], [], 0
            part = text[start : start + step + LENGTH - 1]
            data.append(part)
            total += len(part)
            ends.append(total)
            docs.append(doc)
            begins.append(start)
    if data:
        yield packed()


def around(text: bytes, place: int) -> bytes:
    """The gram with its contexts, as long as the text reaches."""
    return text[max(0, place - REACH) : place + GRAM + REACH]


def contexts(texts: dict[int, bytes], docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hash of each anchor's gram and surroundings, and of how far the text reaches on either side."""
    out = np.zeros(len(docs), np.uint64)
    for a, b in stretches(docs):
        text, p = texts[int(docs[a])], places[a:b]
        low, high = int(p.min()), int(p.max()) + GRAM + REACH
        near = bytes(max(0, REACH - low)) + text[max(0, low - REACH) : high] + bytes(max(0, high - len(text)) + 8)
        h, q = hashes(eights(np.frombuffer(near, np.uint8)), REACH), p - low
        reach = np.minimum(p, REACH) * 64 + np.minimum(len(text) - p - GRAM, REACH)
        gram = mixed(h[q + REACH] * M1 + h[q + GRAM])  # the two overlap and cover it
        out[a:b] = mixed(mixed(mixed(h[q] * M1 + gram) * M1 + h[q + GRAM + REACH]) + reach.astype(np.uint64))
    return out


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Arrays of one length: byte planes, compressed."""
    n = len(next(iter(columns.values())))
    planes = [np.array([n], np.int64).tobytes()]
    for name, values in columns.items():
        planes.append(np.ascontiguousarray(values.astype(TYPES[name])).view(np.uint8).reshape(n, -1).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, names: Iterable[str] = ("gram", "context", "doc", "place")) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw[:8], np.int64)[0]), 8, {}
    for name in names:
        kind = np.dtype(TYPES[name])
        size = n * kind.itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(raw[at : at + size], np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(-1)
        at += size
    return out


Run = dict[str, np.ndarray]


def ordered(run: Run) -> Run:
    """Sorted by gram, context, document and place: by one number, and by all four only where it ties."""
    key = (run["gram"].astype(np.uint64) << np.uint64(32)) | (run["context"] >> np.uint64(32))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    if len(tied):
        part = order[tied]
        order[tied] = part[np.lexsort((run["place"][part], run["doc"][part], run["context"][part], key[tied]))]
    return {k: v[order] for k, v in run.items()}


def together(runs: list[Run]) -> Run:
    return {k: np.concatenate([r[k] for r in runs]) for k in TYPES}


def carried(sizes: list[int], size: int) -> int:
    """How many of the last levels a new one of ``size`` is merged with."""
    n = 0
    while n < len(sizes) and sizes[-1 - n] <= GROWTH * size:
        size += sizes[-1 - n]
        n += 1
    return n


def scan(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted run: repeats with their whole context, and the anchors to look up."""
    gram, context, doc = run["gram"], run["context"], run["doc"]
    n = len(gram)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
    new_both = new_gram | np.concatenate(([True], context[1:] != context[:-1]))
    g, c = np.cumsum(new_gram) - 1, np.cumsum(new_both) - 1
    starts_g, starts_c = np.flatnonzero(new_gram), np.flatnonzero(new_both)
    low, high = np.minimum.reduceat(doc, starts_g), np.maximum.reduceat(doc, starts_g)
    first = doc[starts_c][c]
    several = (low < high) & (np.bincount(g[starts_c]) > 1)
    return np.flatnonzero(doc > first), np.flatnonzero((doc == first) & several[g])


def added(new: Run, old: list[Run]) -> tuple[Run, np.ndarray, np.ndarray]:
    """The anchors with a gram of the sorted run ``new``, and which of them it makes repeats and lookups."""
    if not old:
        return new, *scan(new)
    before = together(old)
    at = np.minimum(np.searchsorted(new["gram"], before["gram"]), len(new["gram"]) - 1)
    met = new["gram"][at] == before["gram"]
    before = ordered({k: v[met] for k, v in before.items()})
    both = together([before, new])
    both["new"] = np.arange(len(both["gram"])) >= len(before["gram"])
    both = ordered(both)
    mine = np.flatnonzero(~both["new"])
    found = [np.setdiff1d(now, mine[then]) for now, then in zip(scan(both), scan(before), strict=True)]
    return both, *found


class Bloom:
    """A set of keys that may also claim keys it does not hold."""

    def __init__(self, size: int, bits: np.ndarray | None = None):
        self.size, self.bits = size, np.zeros(size // 8, np.uint8) if bits is None else bits

    def _spots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (mixed(keys + np.uint64(probe + 1)) % np.uint64(self.size)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for probe in range(PROBES):
            spots = self._spots(keys, probe)
            np.bitwise_or.at(self.bits, spots >> 3, (1 << (spots & 7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for probe in range(PROBES):
            spots = self._spots(keys, probe)
            out &= (self.bits[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 > 0
        return out


def _texts(piece: pa.RecordBatch) -> list[tuple[int, bytes]]:
    rows = zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True)
    return [(d, t.encode("utf-8", "replace")) for d, t in rows]


def _found(texts: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the text, document, place, gram hash) of all anchors, in text order, each once."""
    numbered = [(i, t) for i, (_, t) in enumerate(texts)]
    ids = np.array([d for d, _ in texts], np.int64)
    for data, ends, rows, begins in pieces(numbered):
        at, h = anchors(data, ends)
        own = np.searchsorted(ends, at, "right")
        place = at - np.concatenate(([0], ends[:-1]))[own] + begins[own]
        yield rows[own], ids[rows[own]], place, h


def runs(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, run): the anchors of each piece of the batch, by shard, not sorted yet."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            texts, parts = _texts(piece), []
            lookup = dict(enumerate(t for _, t in texts))
            for rows, doc, place, h in _found(texts):
                parts.append((h, contexts(lookup, rows, place), doc, place))
            if not parts:
                continue
            h, context, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            shard = (h % np.uint64(shards)).astype(np.int64)
            gram = (h >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(shard, kind="stable")
            shard, columns = shard[order], {"gram": gram[order], "context": context[order], "doc": doc[order], "place": place[order]}
            spans = stretches(shard)
            blobs = [pack({k: v[a:b] for k, v in columns.items()}) for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in spans], pa.int32()), pa.array(blobs, pa.binary())], ["shard", "run"])

    return docs.mapInArrow(work, "shard int, run binary")


FOUND = "shard int, kind string, n long, docs binary, places binary, run binary"


def _filled(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)})


def _scanned(rows: pa.Table, shard: int) -> pa.Table:
    """A shard's part of a batch as one sorted run, and what it adds to the levels: repeats and lookups."""
    old, new = [], []
    for kind, run in zip(rows.column("kind").to_pylist(), rows.column("run").to_pylist(), strict=True):
        (old if kind == "level" else new).append(unpack(run))
    out = []
    if new:
        run = ordered(together(new))
        out.append((shard, "level", len(run["gram"]), None, None, pack(run)))
        both, *found = added(run, old)
        for kind, at in zip(("repeat", "lookup"), found, strict=True):
            if len(at):
                out.append((shard, kind, len(at), pack({"doc": both["doc"][at]}), pack({"place": both["place"][at]}), None))
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return _filled(out, pa.schema([*zip(("shard", "kind", "n", "docs", "places", "run"), kinds, strict=True)]))


def _merged(rows: pa.Table, shard: int) -> pa.Table:
    run = ordered(together([unpack(b) for b in rows.column("run").to_pylist()]))
    return _filled([(shard, len(run["gram"]), pack(run))], pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("run", pa.binary())]))


@dataclass(frozen=True)
class SuffixIndex:
    """The folders of the levels, largest first, with their sizes, and those of what each batch's scan found.

    A version never changes and its folders are never written again, so a failed insert leaves the older one whole.
    ``shards`` is fixed by the first batch: name more where much larger ones will follow.
    """

    spark: SparkSession
    path: str
    shards: int
    levels: tuple[tuple[str, int], ...] = ()
    scans: tuple[str, ...] = ()

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, shards: int | None = None) -> SuffixIndex:
        """From a first batch with the columns doc_id (long) and text."""
        spark = docs.sparkSession
        if shards is None:
            size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            shards = max(8, -(-size // SHARD_BYTES))
        return cls(spark, path or scratch_path(spark, "suffix-index"), shards).insert(docs)

    def _runs(self, folders: Iterable[str]) -> DataFrame:
        """(shard, kind, run) of levels."""
        parts = [self.spark.read.schema(FOUND).parquet(f).where("kind = 'level'") for f in folders]
        return reduce(DataFrame.unionByName, parts).select("shard", "kind", "run")

    def found(self, kind: str) -> DataFrame:
        """(shard, docs, places): all repeats or lookups."""
        return self.spark.read.schema(FOUND).parquet(*self.scans).where(F.col("kind") == kind).select("shard", "docs", "places")

    def insert(self, docs: DataFrame) -> SuffixIndex:
        """The index with a further batch."""
        rows = runs(docs, self.shards).select("shard", F.lit("run").alias("kind"), "run")
        if self.levels:
            rows = rows.unionByName(self._runs(f for f, _ in self.levels))
        batch = f"{self.path}/batch-{uuid.uuid4().hex}"
        rows.groupBy("shard").applyInArrow(lambda key, part: _scanned(part, key[0].as_py()), FOUND).write.parquet(batch)
        size = self.spark.read.schema(FOUND).parquet(batch).where("kind = 'level'").agg(F.sum("n")).first()[0] or 0
        levels, scans = [*self.levels, (batch, size)], (*self.scans, batch)
        n = carried([size for _, size in self.levels], size)
        if n:
            last, levels = levels[-1 - n :], levels[: -1 - n]
            level = f"{self.path}/level-{uuid.uuid4().hex}"
            made = self._runs(f for f, _ in last).groupBy("shard")
            made = made.applyInArrow(lambda key, part: _merged(part, key[0].as_py()), "shard int, n long, run binary")
            made.withColumn("kind", F.lit("level")).write.parquet(level)
            levels.append((level, sum(size for _, size in last)))
        return replace(self, levels=tuple(levels), scans=scans)

    def ranges(self, docs: DataFrame) -> DataFrame:
        """(doc_id, starts, ends): the merged byte ranges that each document loses.

        ``docs`` are all documents of the index.
        """
        return _per_document(self._repeats().unionByName(self._ends(docs)), self.shards)

    def _repeats(self) -> DataFrame:
        """Ranges around anchors whose whole context is a repeat; ends beyond a text are cut later."""

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, p in zip(batch.column("docs").to_pylist(), batch.column("places").to_pylist(), strict=True):
                    docs, place = unpack(d, ["doc"])["doc"], unpack(p, ["place"])["place"].astype(np.int64)
                    yield from _dealt(docs, np.maximum(place - REACH, 0), place + GRAM + REACH, shards)

        shards = self.shards
        return self.found("repeat").select("docs", "places").mapInArrow(work, RANGES)

    def _ends(self, docs: DataFrame) -> DataFrame:
        """Ranges of the strings at the ends of repeats: the texts are read once, whatever the number of lookups."""
        wanted = _wanted(self.found("lookup"), self.shards)
        shards = self.shards
        return _sought(docs.join(wanted, "doc_id")).groupBy("shard").applyInArrow(lambda key, rows: _compared(rows, shards), RANGES)


def _wanted(lookups: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, places, shards): the anchors to look up in each document."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, d, p in zip(*(batch.column(n).to_pylist() for n in ("shard", "docs", "places")), strict=True):
                doc, place = unpack(d, ["doc"])["doc"], unpack(p, ["place"])["place"]
                bucket = (mixed(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                doc, place, bucket = doc[order], place[order], bucket[order]
                out += [(int(bucket[a]), shard, pack({"doc": doc[a:b]}), pack({"place": place[a:b]})) for a, b in stretches(bucket)]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield from _filled(out, pa.schema([*zip(("bucket", "shard", "docs", "places"), kinds, strict=True)])).to_batches()

    def gather(rows: pa.Table) -> pa.Table:
        parts = [
            (unpack(d, ["doc"])["doc"], unpack(p, ["place"])["place"], shard)
            for shard, d, p in zip(*(rows.column(n).to_pylist() for n in ("shard", "docs", "places")), strict=True)
        ]
        doc, place = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        shard = np.repeat(np.array([p[2] for p in parts], np.int32), [len(p[0]) for p in parts])
        order = np.lexsort((place, doc))
        doc, place, shard = doc[order], place[order], shard[order]
        one = np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])))  # batches may find one again
        doc, place, shard = doc[one], place[one], shard[one]
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        offsets = pa.array(np.append(first, len(doc)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place.astype(np.int64), shard)]
        return pa.table({"doc_id": pa.array(doc[first], pa.int64()), "places": lists[0], "shards": lists[1]})

    dealt = lookups.mapInArrow(deal, "bucket int, shard int, docs binary, places binary")
    return dealt.groupBy("bucket").applyInArrow(gather, "doc_id long, places array<long>, shards array<int>")


def _sought(found: DataFrame) -> DataFrame:
    """(shard, docs, places, sizes, near): the bytes around the wanted anchors of each text, packed."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            near, docs, places, shards = [], [], [], []
            for (doc, text), p, s in zip(_texts(piece), piece.column("places").to_pylist(), piece.column("shards").to_pylist(), strict=True):
                near += [around(text, place) for place in p]
                docs.append(np.full(len(p), doc, np.int64))
                places += p
                shards += s
            doc, place, shard = np.concatenate(docs), np.array(places, np.int64), np.array(shards, np.int64)
            order = np.argsort(shard, kind="stable")
            shard, out = shard[order], []
            for a, b in stretches(shard):
                own = order[a:b]
                texts = [near[i] for i in own.tolist()]
                sizes = np.array([*map(len, texts)], np.uint8).tobytes()
                packed = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
                out.append((int(shard[a]), pack({"doc": doc[own]}), pack({"place": place[own]}), sizes, packed))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield from _filled(out, pa.schema([*zip(("shard", "docs", "places", "sizes", "near"), kinds, strict=True)])).to_batches()

    return found.mapInArrow(work, "shard int, docs binary, places binary, sizes binary, near binary")


RANGES = "bucket int, docs binary, starts binary, ends binary"


def _dealt(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The ranges, merged where they meet, as one packed row per bucket of documents."""
    docs, starts, ends = joined(docs, starts, ends)
    bucket = (mixed(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, docs, starts, ends = bucket[order], docs[order], starts[order], ends[order]
    spans = stretches(bucket)
    if spans:
        columns = [
            pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
            pa.array([pack({"doc": docs[a:b]}) for a, b in spans], pa.binary()),
            pa.array([pack({"place": starts[a:b]}) for a, b in spans], pa.binary()),
            pa.array([pack({"place": ends[a:b]}) for a, b in spans], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "docs", "starts", "ends"])


def joined(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted by document and start, merged where they overlap or touch."""
    if not len(docs):
        return docs, starts, ends
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    part = np.cumsum(np.diff(docs, prepend=docs[0]) != 0)
    step = int(ends.max()) + 1
    far = np.maximum.accumulate(ends + part * step) - part * step  # the furthest end so far in the document
    new = np.concatenate(([True], (part[1:] != part[:-1]) | (starts[1:] > far[:-1])))
    first = np.flatnonzero(new)
    return docs[first], starts[first], np.maximum.reduceat(ends, first)


def _compared(rows: pa.Table, buckets: int) -> pa.Table:
    """Compare the strings around looked-up anchors of one shard; ranges of those in a smaller document."""
    docs, starts, keys = [], [], []
    for d, p, s, near in zip(*(rows.column(n).to_pylist() for n in ("docs", "places", "sizes", "near")), strict=True):
        doc, place = unpack(d, ["doc"])["doc"], unpack(p, ["place"])["place"].astype(np.int64)
        size = np.frombuffer(s, np.uint8).astype(np.int64)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(near) + bytes(64), np.uint8)
        begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        h = hashes(eights(data), LENGTH)
        n = np.maximum(size - LENGTH + 1, 0)  # whole strings around each anchor
        own = np.repeat(np.arange(len(doc)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        docs.append(doc[own])
        starts.append(np.maximum(place - REACH, 0)[own] + step)
        keys.append(h[begin[own] + step])
    doc, start, key = np.concatenate(docs), np.concatenate(starts), np.concatenate(keys)
    order = np.lexsort((doc, key))
    doc, start, key = doc[order], start[order], key[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    low = np.repeat(doc[new], np.diff(np.append(new, len(key))))
    at = np.flatnonzero(doc > low)
    found = [*_dealt(doc[at], start[at], start[at] + LENGTH, buckets)]
    schema = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
    return pa.Table.from_batches(found, schema)


def _per_document(dealt: DataFrame, buckets: int) -> DataFrame:
    def gather(rows: pa.Table) -> pa.Table:
        unpacked = [
            (unpack(d, ["doc"])["doc"], unpack(s, ["place"])["place"], unpack(e, ["place"])["place"])
            for d, s, e in zip(*(rows.column(n).to_pylist() for n in ("docs", "starts", "ends")), strict=True)
        ]
        docs, starts, ends = joined(*(np.concatenate(x) for x in zip(*unpacked, strict=True)))
        first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        offsets = pa.array(np.append(first, len(docs)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64), pa.int64())) for x in (starts, ends)]
        return pa.table({"doc_id": pa.array(docs[first], pa.int64()), "starts": lists[0], "ends": lists[1]})

    return dealt.groupBy("bucket").applyInArrow(gather, "doc_id long, starts array<long>, ends array<long>")


def cut(docs: DataFrame, ranges: DataFrame, *, keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``keep`` and kept (binary), n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    names = [doc_id, *keep]
    frame = docs.select(*(F.col(f"`{k}`") for k in names), F.col(f"`{text}`").cast("string").alias("__text"), F.col(f"`{doc_id}`").cast("long").alias("__id"))
    lost = ranges.select(F.col("doc_id").alias("__doc"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"))
    frame = frame.join(lost, F.col("__id") == F.col("__doc"), "left").drop("__id", "__doc")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "__text"):
            out = []
            for t, starts, ends in zip(*(piece.column(n).to_pylist() for n in ("__text", "__starts", "__ends")), strict=True):
                raw, parts, at = (t or "").encode("utf-8", "replace"), [], 0
                for a, b in zip(starts or (), ends or (), strict=True):
                    parts.append(raw[at:a])
                    at = min(b, len(raw))
                kept = b"".join([*parts, raw[at:]])
                out.append((kept, len(raw), len(raw) - len(kept), len(parts), hashlib.sha256(kept).hexdigest()))
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(i) for i in range(len(names))), *made], [*names, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-3])
    return frame.mapInArrow(work, types + "kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def indexable(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where(
        "doc_id is not null and text is not null"
    )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    source = indexable(docs, doc_id, text)
    index = SuffixIndex.build(source)
    return cut(docs, stored(index.ranges(source), "ranges"), doc_id=doc_id, text=text)


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
