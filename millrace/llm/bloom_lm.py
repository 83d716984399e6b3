"""Language-model scoring with log-frequency Bloom filters.

The model learns words and pairs of neighbouring words (with a start mark before and an end after
each text) from the training documents.  A count is quantised to a level, 1 + floor(log(count) / log(BASE)),
and a gram of level L is put into a Bloom filter once per level 1 to L; its count is read back by asking for
level 1, 2, ... until one is missing.  Pairs need ``pair_count`` occurrences: with 1, as in the query, none is left out.  A level stands for counts from low(x)
to high(x), q(x) is their middle, Q the sum of q over all distinct words, and

    P(w | v) = MIX * low(v w) / high(v) + (1 - MIX) * (q(w) + 0.1) / (Q + 0.1 * (V + 1)).

Over all w and one unknown word the second part sums to 1 - MIX and the first to MIX at most, so P never
sums to more than 1, but for the filter's few false positives.

Tasks count grams over all training documents and send them on as sorted 32-bit fingerprints per
shard of the hash space, one blob per shard and task.  The number of shards follows the number of
tokens, so a shard stays small however large the corpus is, and a frequent gram is one entry per task.  Each
shard's task merges its blobs and builds its filter.

Filters are broadcast in blocks of at most ``BLOCK_BYTES``, each in parts of ``PART_BYTES``.  Documents are scanned once per
block; the levels found so far are written down with the texts as a byte per gram, and the block is destroyed before the next is
sent.  Workers and broadcasts therefore hold one block at a time, the driver collects one part at a time, and a model of any size is used whole.

The base score needs exact counts.  The most frequent words, at most ``HOT_WORDS`` of at most
``HOT_BYTES`` bytes each, are broadcast with theirs; all other words of a document meet the count table in a
join on the word, which no longer holds any frequent key.

Definitions for odd input: NULL text is the empty text and has the end as its only token; without training
tokens every word is unknown; a NULL id counts as the empty text in the fold; repeated rows are scored each;
an empty table gives an empty table.  A very long text is a piece of its own: its task holds that text and a few
numbers per word of it.  Extra columns are never read; those in ``keep`` may have any name but the results'.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import fold_of, slices, stored, table

BASE = 1.5
PAIR_COUNT = 2  # where the caller names none
MIX = 0.2
SHARD_TOKENS = 4 << 20
BITS, PROBES = 12, 6  # bits per entry, hash functions
BLOCK_BYTES = 128 << 20  # filters asked in one scan
PART_BYTES = 12 << 20  # filters that pass through the driver at once
HOT_WORDS, HOT_BYTES = 100_000, 48
PIECE_BYTES, SCORE_BYTES = 3 << 20, 3 << 20  # text counted, text scored at once inside a task; a worker needs some 20 times that
END = b"\n"  # no word holds it
START = np.uint64(0x5851F42D4C957F2D)
SEED = 42  # of Spark's xxhash64
LOW = np.uint64(0xFFFFFFFF)
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SOLID = np.ones(256, bool)  # bytes of words; all others part them
SOLID[[0x20, *range(0x09, 0x0E)]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * M1 + mixed(word))


def level(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, one more per factor BASE."""
    return (np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9) + 1).astype(np.int64)


def bounds(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest count a level stands for, 0 for none."""
    low = np.ceil(BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** (levels * 1.0) - 1e-9) - 1)
    return np.where(levels > 0, low, 0.0), np.where(levels > 0, high, 0.0)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of its range, 0 for none."""
    return sum(bounds(levels)) / 2


def as_text(words: pa.Array) -> pa.Array:
    return pc.cast(words, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))


class Words:
    """Words of one piece as small numbers, with their hashes; the last number is the end."""

    def __init__(self, texts: pa.Array):
        raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
        at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        held = raw.buffers()[2] if len(raw) else None
        data = LOWER[np.frombuffer(held or b"", np.uint8)[at[0] : at[-1]]]
        begin, stop = at[:-1] - at[0], at[1:] - at[0]
        solid = SOLID[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = begin[begin < len(data)]
        first[inner] = solid[inner]  # no word goes over from one text into the next
        heads = np.flatnonzero(first)
        lengths = np.add.reduceat(solid, heads, dtype=np.int64) if len(heads) else heads
        ends = pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int64))
        words = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, ends, pa.py_buffer(data[solid])])
        coded = words.dictionary_encode()
        self.words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_binary())])
        cuts = np.searchsorted(heads, stop)
        self.at = np.insert(coded.indices.to_numpy().astype(np.int64), cuts, len(self.words) - 1)
        self.starts = np.append(0, cuts[:-1] + np.arange(1, len(cuts))) if len(cuts) else cuts
        # as Spark's xxhash64 of each word
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in self.words.to_pylist()), np.uint64, len(self.words))

    def pairs(self) -> np.ndarray:
        """Hash of each token with the one before it."""
        word = self.hashes[self.at]
        before = np.concatenate((word[:1], word[:-1]))
        before[self.starts] = START
        return pair_hash(before, word)

    def histories(self) -> np.ndarray:
        """Number of the word before each token; -1 for the start."""
        before = np.concatenate((self.at[:1], self.at[:-1]))
        before[self.starts] = -1
        return before


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a frame with the one column ``text``; the end is a word."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE_BYTES):
            w = Words(piece.column("text"))
            counts = np.bincount(w.at, minlength=len(w.words))
            yield pa.RecordBatch.from_arrays([as_text(w.words), pa.array(counts, pa.int64())], ["word", "n"])

    return texts.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


COUNTS = (np.int64, np.uint32)  # per kind
BLOB = "kind int, shard int, marks binary, counts binary"


def _blobs(kind: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """Per shard the sorted 32-bit fingerprints and their counts, of 32 bits for the pairs of one piece, else of 64."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    marks = (keys >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((marks, shard))
    shard, marks, counts = shard[order], marks[order], counts[order].astype(COUNTS[kind])
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = np.append(cuts[1:], len(shard))
    pack = lambda x: zlib.compress(x.tobytes(), 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(cuts), pa.int32()),
            pa.array(shard[cuts], pa.int32()),
            pa.array([marks[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            pa.array([pack(counts[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        ],
        ["kind", "shard", "marks", "counts"],
    )


def pair_pieces(batches: Iterable[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text", PIECE_BYTES):
        keys, counts = np.unique(Words(piece.column("text")).pairs(), return_counts=True)
        yield _blobs(1, keys, counts, shards)


def pair_blobs(texts: DataFrame, shards: int) -> DataFrame:
    return texts.mapInArrow(lambda batches: pair_pieces(batches, shards), BLOB)


def word_blobs(counts: DataFrame, shards: int) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _blobs(0, batch.column("h").to_numpy().astype(np.uint64), batch.column("n").to_numpy(), shards)

    return counts.select(F.xxhash64("word").alias("h"), "n").mapInArrow(work, BLOB)


def halves(kind: int, marks: np.ndarray, lev: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 32 bits of each gram at a level; probe i looks at their combination first + i * second."""
    seed = np.full(1, (kind << 48) + lev, np.uint64) * M1
    h = mixed(marks.astype(np.uint64) + seed)
    return h & LOW, h >> np.uint64(32) | np.uint64(1)


def places(first: np.ndarray, second: np.ndarray, probe: int, size: np.ndarray) -> np.ndarray:
    """The bits that a probe looks at in filters of ``size`` bits, fewer than 2^32."""
    return ((first + np.uint64(probe) * second) & LOW) * size >> np.uint64(32)


def build_filter(kind: int, marks: np.ndarray, counts: np.ndarray, least: int = 1) -> np.ndarray:
    """One bit array, packed; the counts of equal marks are added first, and those below ``least`` left out."""
    order = np.argsort(marks, kind="stable")
    marks, counts = marks[order], counts[order]
    first = np.flatnonzero(np.diff(marks.astype(np.int64), prepend=-1))
    total = np.add.reduceat(counts.astype(np.int64), first) if len(first) else counts
    marks, total = marks[first][total >= least], total[total >= least]
    levels = level(total)
    size = max(64, -(-int(levels.sum()) * BITS // 8) * 8)
    bits = np.zeros(size, bool)
    for lev in range(1, int(levels.max(initial=0)) + 1):
        first, second = halves(kind, marks[levels >= lev], lev)
        for probe in range(PROBES):
            bits[places(first, second, probe, np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def build_filters(blobs: DataFrame, pair_count: int) -> DataFrame:
    """(kind, shard, bits)"""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        marks = np.concatenate([np.frombuffer(m, np.uint32) for m in rows.column("marks").to_pylist()])
        kind, shard = key[0].as_py(), key[1].as_py()
        counts = np.concatenate([np.frombuffer(zlib.decompress(c), COUNTS[kind]) for c in rows.column("counts").to_pylist()])
        bits = build_filter(kind, marks, counts, pair_count if kind == 1 else 1).tobytes()
        return pa.table({"kind": pa.array([kind], pa.int32()), "shard": pa.array([shard], pa.int32()), "bits": pa.array([bits], pa.binary())})

    return blobs.groupBy("kind", "shard").applyInArrow(build, "kind int, shard int, bits binary")


class Filters:
    """Some of the filters as one bit array."""

    def __init__(self, shards: int, parts: list[tuple[int, int, bytes]]):
        self.shards = shards
        self.size, self.start = np.zeros((2, shards), np.uint64), np.zeros((2, shards), np.uint64)
        at = 0
        for kind, shard, bits in parts:
            self.size[kind, shard], self.start[kind, shard] = len(bits) * 8, at * 8
            at += len(bits)
        self.bits = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)

    @classmethod
    def of(cls, state: dict) -> Filters:
        filters = cls.__new__(cls)
        vars(filters).update(state)
        return filters

    def levels(self, kind: int, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        """``known`` with the levels of the grams whose shard is here."""
        if not self.size[kind].any():
            return known
        out = known.copy()
        shard = (keys % np.uint64(self.shards)).astype(np.int64)
        left = np.flatnonzero(self.size[kind, shard])
        marks, size, start = (keys[left] >> np.uint64(32)), self.size[kind, shard[left]], self.start[kind, shard[left]]
        lev = 0
        while len(left):
            lev += 1
            first, second = halves(kind, marks, lev)
            for probe in range(PROBES):
                spot = places(first, second, probe, size) + start
                hit = (self.bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                left, marks, size, start = left[hit], marks[hit], size[hit], start[hit]
                first, second = first[hit], second[hit]
            out[left] = lev
        return out


def asked(filters: list[Filters], kind: int, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``known`` with the levels of all grams whose shard is in one of ``filters``; each of these sees its own grams only."""
    if not filters or not len(keys):
        return known
    holder = np.full(filters[0].shards, len(filters), np.int16)
    for i, f in enumerate(filters):
        holder[f.size[kind] > 0] = i
    at = holder[(keys % np.uint64(filters[0].shards)).astype(np.int64)]
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(len(filters) + 1))
    out = known.copy()
    for f, a, b in zip(filters, cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        out[own] = f.levels(kind, keys[own], known[own])
    return out


class Model:
    """What training leaves: totals, the count table, the stored filters and the frequent words."""

    def __init__(self, counts: DataFrame, filters: DataFrame, shards: int, total: int, distinct: int, middles: float, starts: int, hot: pa.Table):
        self.counts, self.filters, self.shards, self.hot = counts, filters, shards, hot
        self.total, self.distinct, self.middles, self.starts = total, distinct, middles, starts


def train(docs: DataFrame, text: str = "text", pair_count: int = PAIR_COUNT) -> Model:
    """The model of all texts; pairs seen fewer than ``pair_count`` times are no part of it."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    counts = stored(word_counts(texts), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    starts = counts.where(F.col("word") == END.decode()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts_of_counts = counts.groupBy((F.floor(F.log(F.col("n")) / math.log(BASE) + 1e-9) + 1).alias("level")).count().collect()  # a row per level
    middles = sum(float(count_of(np.array([r[0]]))[0]) * r[1] for r in counts_of_counts)
    shards = max(4, -(-total // SHARD_TOKENS))
    filters = stored(build_filters(pair_blobs(texts, shards).unionByName(word_blobs(counts, shards)), pair_count), "filters")
    by_count = counts.where(F.octet_length("word") <= HOT_BYTES).groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count(F.lit(1)).alias("words"))
    least, room = 1, HOT_WORDS
    for r in sorted(by_count.collect(), key=lambda r: -r.n):  # a row per count: few
        room -= r.words
        if room < 0:
            least = r.n + 1
            break
    hot = counts.where((F.col("n") >= least) & (F.octet_length("word") <= HOT_BYTES)).toArrow()
    return Model(counts, filters, shards, int(total), int(distinct), float(middles), int(starts), hot)


Filter = tuple[int, int, int]  # kind, shard, bytes


def grouped(filters: list[Filter], most: int) -> list[list[Filter]]:
    """Filters in order, in groups of at most ``most`` bytes, one filter at least; one empty group for none."""
    out, room = [[]], most
    for f in filters:
        if f[2] > room and out[-1]:
            out.append([])
            room = most
        out[-1].append(f)
        room -= f[2]
    return out


def blocks(model: Model) -> list[list[Filter]]:
    """Filters by scan of the documents."""
    sizes = model.filters.select("kind", "shard", F.octet_length("bits").alias("b")).collect()
    return grouped(sorted((r.kind, r.shard, r.b) for r in sizes), BLOCK_BYTES)


def sent(model: Model, block: list[Filter]) -> list:
    """The filters of a block as broadcasts of ``PART_BYTES``; the driver holds one of these at a time."""
    out = []
    for part in grouped(block, PART_BYTES):
        wanted = F.lit(False)
        for kind in (0, 1):
            own = [s for k, s, _ in part if k == kind]
            if own:
                wanted = wanted | ((F.col("kind") == kind) & F.col("shard").between(min(own), max(own)))
        rows = model.filters.where(wanted).collect()
        out.append(model.filters.sparkSession.sparkContext.broadcast(vars(Filters(model.shards, [tuple(r) for r in rows]))))
        del rows
    return out


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, n_tokens, n_known, base_score and score of every text."""
    spark = docs.sparkSession
    names = [*keep]
    frame = docs.select(
        *(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").cast("string").alias("__text"), F.lit(None).cast("binary").alias("__levels")
    )
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-2])
    hot_words = model.hot.column("word").combine_chunks().cast(pa.large_binary())
    hot = spark.sparkContext.broadcast((hot_words, model.hot.column("n").to_numpy()))
    found = blocks(model)
    bottom = model.total + 0.1 * (model.distinct + 1)
    for i, block in enumerate(found):
        last = i == len(found) - 1
        shared = sent(model, block)
        result = "n_tokens long, score double, hot_score double, hot_known long, tail array<struct<word:string,n:long>>"
        frame = frame.mapInArrow(_task(shared, hot, names, model, last), kept + (result if last else "__text string, __levels binary"))
        frame = stored(frame.select("*", F.monotonically_increasing_id().alias("__row")) if last else frame, "scored")
        for part in shared:
            part.destroy()  # what it was for is written down
    rows = frame
    own = "log10((coalesce(c, 0) + 0.1) / {b}D)".format(b=repr(bottom))
    rare = rows.select("__row", F.explode("tail").alias("t")).select("__row", "t.word", "t.n")
    rare = rare.join(model.counts.select("word", F.col("n").alias("c")), "word", "left")
    rare = rare.groupBy(F.col("__row").alias("__of")).agg(
        F.sum(F.expr(f"n * {own}")).alias("rare_score"), F.sum(F.expr("if(c is null, 0, n)")).alias("rare_known")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.join(rare, rows["__row"] == rare["__of"], "left").select(
        *(F.col(f"`{k}`") for k in keep),
        "n_tokens",
        (F.col("hot_known") + zero("rare_known")).alias("n_known"),
        (F.col("hot_score") + zero("rare_score")).alias("base_score"),
        "score",
    )


def _task(shared, hot, names: list[str], model: Model, last: bool):
    starts, unseen = model.starts, 0.1 * (model.distinct + 1)
    bottom, spread = model.total + unseen, model.middles + unseen

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, (hot_words, hot_counts) = [Filters.of(part.value) for part in shared], hot.value
        hot_counts = np.append(hot_counts, -1)  # behind the last: not among them
        for piece in slices(batches, "__text", SCORE_BYTES):
            kept = [piece.column(i) for i in range(len(names))]
            before = piece.column("__levels").to_pylist()
            w = Words(piece.column("__text"))
            ends = np.append(w.starts[1:], len(w.at))
            pairs, which = np.unique(w.pairs(), return_inverse=True)
            known_words, known_pairs = np.zeros(len(w.words), np.uint8), np.zeros(len(pairs), np.uint8)
            if before and before[0] is not None:
                packed = np.frombuffer(b"".join(before), np.uint8).reshape(-1, 2)
                known_words[w.at] = packed[:, 0]
                known_pairs[which] = packed[:, 1]
            known_words = asked(filters, 0, w.hashes, known_words)
            known_pairs = asked(filters, 1, pairs, known_pairs)
            if not last:
                packed = np.stack((known_words[w.at], known_pairs[which]), 1)
                carried = [packed[a:b].tobytes() for a, b in zip(w.starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, piece.column("__text"), pa.array(carried, pa.binary())], [*names, "__text", "__levels"])
                continue
            levels = known_words.astype(np.int64)
            words = count_of(levels)
            history = np.append(bounds(levels)[1], float(starts))[w.histories()]
            share = bounds(known_pairs.astype(np.int64))[0][which] / np.maximum(history, 1)
            prob = MIX * np.minimum(share, 1) + (1 - MIX) * (words[w.at] + 0.1) / spread
            score = np.add.reduceat(np.log10(prob), w.starts)
            exact = hot_counts[pc.fill_null(pc.index_in(w.words, value_set=hot_words), len(hot_words)).to_numpy(zero_copy_only=False)].astype(float)
            is_hot = exact >= 0
            single = np.where(is_hot, np.log10((np.maximum(exact, 0) + 0.1) / bottom), 0.0)
            hot_score = np.add.reduceat(single[w.at], w.starts)
            hot_known = np.add.reduceat(is_hot[w.at].astype(np.int64), w.starts)
            cold = np.flatnonzero(~is_hot[w.at])  # (document, word) pairs and how often each occurs
            row = np.repeat(np.arange(len(ends)), ends - w.starts)[cold]
            both, n = np.unique(row * len(w.words) + w.at[cold], return_counts=True)
            rare = as_text(w.words.take(pa.array(both % len(w.words))))
            offsets = np.searchsorted(both // len(w.words), np.arange(len(ends) + 1))
            pairs_of = pa.StructArray.from_arrays([rare, pa.array(n, pa.int64())], ["word", "n"])
            tails = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs_of)
            made = [pa.array(ends - w.starts), pa.array(score), pa.array(hot_score), pa.array(hot_known), tails]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*names, "n_tokens", "score", "hot_score", "hot_known", "tail"])

    return work


def op6_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = fold_of("doc_id", 10) == 0
    model = train(docs.where(~held_out), pair_count=1)
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
