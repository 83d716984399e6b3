"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of ``SHINGLE`` words, as 64-bit hashes.  The hashes are dealt into
``BUCKETS`` buckets by their leading bits; of each bucket's smallest hash a register keeps the count of
leading zeros and ``MANTISSA`` bits after the first one: 16 bits.  Empty buckets borrow from a bucket
that hashing picks, the same way for every set, so that a register of two sets agrees with the
probability of their Jaccard similarity J however small they are.

``ROWS`` registers make a band; documents that agree on a band are candidates.  At J = 0.8 all
``BANDS`` bands differ with probability (1 - 0.8^6)^48 = 5e-7.  Before verification J is
estimated from the share of equal registers, corrected for registers that are equal by
chance; only pairs six standard errors below the limit are dropped there (1e-9).  Links are then
confirmed on the full sets.

Groups of any size stay manageable.  Equal sets collapse to their smallest document first.  In each
bucket the smallest member is compared with all others, which joins most groups.  Where a bucket still
spans several components, the members outside its largest one are compared with all that meet around
that component, in a grid of cells of bounded size and without pairs as rows.  Then every
pair of candidates has been compared or is in one component already.

All state is written to the shared folder between steps; nothing but counts reaches the driver.

Definitions for odd input: without words or text a set is empty and linked with nothing; with fewer
words than a shingle the whole sequence is one; rows that repeat an id with one text get one component; if
texts differ under one id each row has its own set, and the id may gather links from both; a NULL id is
a document of its own without links; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import WORDS, ascii_lower, per_process, slices, stored, table
from millrace.llm.suffix_index import Bloom

SHINGLE, PERCENT = 4, 80
ROWS, BANDS, MANTISSA = 6, 48, 10
BUCKETS = ROWS * BANDS
CELL = 256  # sets on each side of a comparison between components
FILTER_BYTES, BLOOM_BITS = 48 << 20, 12
CHANCE = 2.0**-MANTISSA / 3  # two unrelated registers agree: in the zeros a third of the time, and in the mantissa
MARGIN = 6.0
KNOWN_WORDS = 150_000
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = WORDS.findall(ascii_lower(text or ""))
    if not words:
        return np.zeros(0, np.uint64)
    known = per_process("word-hashes", WordHashes)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = _mixed(total * np.uint64(MIX[0]) + h[i : len(h) - n + 1 + i] * np.uint64(MIX[1] + 2 * i))
    return np.unique(total)


def _borrowing() -> np.ndarray:
    """For each bucket the buckets it borrows from, in order: fixed pseudo-random numbers."""
    n, tries = BUCKETS, 512
    cells = np.arange(n * tries, dtype=np.uint64) + np.uint64(1)
    return (_mixed(cells * np.uint64(MIX[2])) % np.uint64(n)).astype(np.uint16).reshape(n, tries)


BORROW = _borrowing()


def registers(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """The compressed registers of a non-empty sorted set, and how many buckets held a hash."""
    spread = _mixed(shingles * np.uint64(MIX[3]))
    place = ((spread >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    value = _mixed(spread + np.uint64(MIX[4])) >> np.uint64(8) | np.uint64(1)  # 56 bits
    order = np.lexsort((value, place))
    place, value = place[order].astype(np.int64), value[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    place, value = place[first], value[first]
    bits = np.frexp(value.astype(np.float64))[1]  # position of the leading one
    shift = bits - 1 - MANTISSA
    top = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.maximum(-shift, 0).astype(np.uint64))
    mantissa = top.astype(np.int64) & ((1 << MANTISSA) - 1)
    out = np.zeros(BUCKETS, np.uint16)
    out[place] = (57 - bits) << MANTISSA | mantissa
    full = out > 0
    empty = np.flatnonzero(~full)
    if len(empty):
        lent = full[BORROW[empty, :16]]
        if not lent.any(1).all():
            lent = full[BORROW[empty]]
        source = BORROW[empty, lent.argmax(1)]
        source = np.where(lent.any(1), source, place[0])
        out[empty] = out[source]
    return out, len(place)


def band_keys(regs: np.ndarray) -> np.ndarray:
    wide = regs.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(MIX[0])
    for i in range(ROWS):
        key = _mixed(key * np.uint64(MIX[1]) + wide[:, i])
    return key.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from registers, less what agrees by chance."""
    return max(0.0, (float((a == b).mean()) - CHANCE) / (1 - CHANCE))


def hopeless(a: np.ndarray, b: np.ndarray, filled: int, percent: int) -> bool:
    """Whether the estimate is so low that similarity can be ruled out."""
    p = percent / 100
    return estimate(a, b) < p - MARGIN * (p * (1 - p) / max(1, filled)) ** 0.5


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def signatures(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, registers, filled."""
    names = ["doc_id", "n_shingles", "digest", "registers", "filled"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            rows = []
            for t in piece.column("text").to_pylist():
                s = shingle_set(t, width)
                if len(s):
                    regs, filled = registers(s)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), regs.tobytes(), filled))
                else:
                    rows.append((0, None, None, 0))
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int32())
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *made], names)

    schema = "doc_id long, n_shingles long, digest binary, registers binary, filled int"
    return _source(docs, doc_id, text).mapInArrow(work, schema)


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, key) for each band."""
    for batch in batches:
        keys = [band_keys(np.frombuffer(r, np.uint16)) for r in batch.column("registers").to_pylist()]
        if keys:
            reps = np.repeat(batch.column("rep").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.concatenate(keys))], ["rep", "key"])


def _row_keys(ids: list[int], digests: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True) + d) for i, d in zip(ids, digests, strict=True)], np.uint64)


def _sets(docs: DataFrame, doc_id: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of the rows in ``wanted`` (rep, digest), found by a broadcast Bloom filter.

    The few rows that the filter lets through wrongly are sets nobody asks for.  Beyond ``FILTER_BYTES``
    the ids are joined instead.
    """
    size = wanted.count() * BLOOM_BITS
    source = _source(docs, doc_id, text).where("doc_id is not null")
    if size > FILTER_BYTES * 8:
        source, bloom = source.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), None
    else:
        bloom = _bloom_of(wanted, max(1024, -(-size // 64) * 64))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            sets = [shingle_set(t, width).tobytes() for t in piece.column("text").to_pylist()]
            ids = piece.column("doc_id")
            keep = [len(s) > 0 for s in sets]
            if bloom is not None:
                found = Bloom(*bloom.value).has(_row_keys(ids.to_pylist(), [xxhash.xxh3_128_digest(s) for s in sets]))
                keep = [k and bool(f) for k, f in zip(keep, found, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], ["rep", "shingles"]).filter(pa.array(keep, pa.bool_()))

    return source.mapInArrow(work, "rep long, shingles binary")


def _bloom_of(wanted: DataFrame, size: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(size)
        for batch in batches:
            bloom.add(_row_keys(batch.column("rep").to_pylist(), batch.column("digest").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([bloom.bits.tobytes()], pa.binary())], ["bits"])

    total = Bloom(size)
    for r in wanted.coalesce(8).mapInArrow(work, "bits binary").toLocalIterator():
        total.bits |= np.frombuffer(bytes(r.bits), np.uint8)
    return wanted.sparkSession.sparkContext.broadcast((total.size, total.bits))


def _promising(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("ra").to_pylist(), batch.column("rb").to_pylist(), batch.column("filled").to_pylist(), strict=True)
        keep = [not hopeless(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16), f, percent) for a, b, f in rows]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame, label: str = "label") -> DataFrame:
    """(node, label): the smallest node reachable from each node of the links (a, b)."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    now = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias(label)), "labels")
    while True:
        near = both.join(now, both.b == now.node).groupBy("a").agg(F.min(label).alias("near"))
        step = now.join(near, now.node == near.a, "left").select("node", F.col(label).alias("was"), F.least(label, "near").alias(label))
        jump = step.select(F.col("node").alias("to"), F.col(label).alias("far"))
        after = stored(
            step.join(jump, F.col(label) == F.col("to"), "left").select("node", "was", F.least(label, "far").alias(label)), "labels"
        )
        if after.where(f"was <> {label}").isEmpty():
            return after.select("node", label)
        now = after.select("node", label)


def _crossed(rows: pa.Table, percent: int) -> pa.Table:
    """Compare the queries of one cell with all its sets: a link per query and part, the closest one."""
    is_query = rows.column("query").to_numpy(zero_copy_only=False)
    reps, parts = rows.column("rep").to_numpy(), rows.column("part").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
    asked, others = np.flatnonzero(is_query), np.flatnonzero(~is_query)
    if not len(asked):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    where = np.repeat(np.arange(len(asked)), [len(sets[i]) for i in asked])
    all_of = np.concatenate([sets[i] for i in asked])
    order = np.argsort(all_of, kind="stable")
    all_of, where = all_of[order], where[order]
    sizes = np.array([len(sets[i]) for i in asked])
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for m in others:
        s = sets[m]
        low, high = np.searchsorted(all_of, s, "left"), np.searchsorted(all_of, s, "right")
        n = high - low
        hits = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(where[hits], minlength=len(asked))
        union = sizes + len(s) - both
        for i in np.flatnonzero((100 * both >= percent * union) & (parts[asked] != parts[m])).tolist():
            key, close = (int(reps[asked[i]]), int(parts[m])), both[i] / union[i]
            if close > best.get(key, (0.0, 0))[0]:
                best[key] = (close, int(reps[m]))
    pairs = [(min(u, m), max(u, m)) for (u, _), (_, m) in best.items()]
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


class NearDuplicates:
    """The steps of one run over ``docs``."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT):
        self.docs, self.doc_id, self.text, self.width, self.percent = docs, doc_id, text, width, percent

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id per row."""
        signed = stored(signatures(self.docs, self.doc_id, self.text, self.width), "signatures")
        some = signed.where("digest is not null and doc_id is not null")
        first = F.min_by(F.struct(F.col("doc_id").alias("rep"), "n_shingles", "registers", "filled"), "doc_id").alias("first")
        own = stored(some.groupBy("digest").agg(first).select("digest", "first.*"), "representatives")
        keyed = own.select("rep", "registers").mapInArrow(_bands, "rep long, key long")
        shared = keyed.groupBy("key").agg(F.min("rep").alias("probe"), F.max("rep").alias("last")).where("probe < last").select("key", "probe")
        members = stored(keyed.join(shared, "key"), "members")
        wanted = own.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "digest")
        sets = stored(_sets(self.docs, self.doc_id, self.text, self.width, stored(wanted, "wanted")), "sets")
        pairs = members.where("rep <> probe").select(F.col("probe").alias("a"), F.col("rep").alias("b")).distinct()
        links = stored(self._verified(pairs, own, sets), "links")
        labels = components(links)
        rest = stored(self._across(members, labels, sets), "links")
        if not rest.isEmpty():
            labels = components(links.unionByName(rest))
        classes = some.select("doc_id", "n_shingles", "digest").join(own.select("digest", "rep"), "digest")
        named = classes.join(labels, classes.rep == labels.node, "left").select(
            "doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id")
        )
        alone = signed.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return named.unionByName(alone)

    def _across(self, members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between the components that still meet in a bucket.

        Around the largest component of a bucket, the members of its other components are compared
        with everything that meets there.  Both sides are cut into chunks; a cell of the grid
        holds CELL sets a side at most, whatever the size of the group.
        """
        placed = members.join(labels, members.rep == labels.node, "left").select("key", "rep", F.coalesce("label", "rep").alias("part"))
        per = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
        spans = per.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
        met = placed.join(spans.where("parts > 1"), "key").groupBy("main", "rep", "part").agg(F.max(F.col("part") != F.col("main")).alias("other"))
        met = stored(met, "meetings")
        chunks = met.groupBy("main").agg(
            F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("wide"), F.ceil(F.sum(F.col("other").cast("int")) / CELL).cast("int").alias("high")
        )
        sized = met.join(chunks, "main")
        column, line = F.pmod(F.xxhash64("rep"), F.col("wide")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("high")).cast("int")
        across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        targets = sized.select("main", "rep", "part", F.lit(False).alias("query"), column.alias("x"), across("high").alias("y"))
        queries = sized.where("other").select("main", "rep", "part", F.lit(True).alias("query"), across("wide").alias("x"), line.alias("y"))
        filled = targets.unionByName(queries).join(sets, "rep")
        percent = self.percent
        found = filled.groupBy("main", "x", "y").applyInArrow(lambda rows: _crossed(rows, percent), "a long, b long")
        return found.distinct()

    def _verified(self, pairs: DataFrame, own: DataFrame, sets: DataFrame) -> DataFrame:
        percent = self.percent
        left = own.select(F.col("rep").alias("a"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"), F.col("filled").alias("fa"))
        right = own.select(F.col("rep").alias("b"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"), F.col("filled").alias("fb"))
        sized = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        near = sized.select("a", "b", "ra", "rb", F.least("fa", "fb").alias("filled")).mapInArrow(
            lambda batches: _promising(batches, percent), "a long, b long"
        )
        full = near.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
        full = full.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
        return full.select("a", "b", "sa", "sb").mapInArrow(lambda batches: _confirmed(batches, percent), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    found = NearDuplicates(docs, doc_id, text, width, percent).run()
    return found.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
