"""Language identification by prediction with partial matching over bytes.

One context tree per language holds how often each byte follows each context of up to ``ORDER``
bytes.  A byte unseen in a context costs an escape (method C: distinct / (total + distinct)) and is
then coded in the next shorter context, without the bytes already ruled out; below the empty context
all 256 bytes cost the same.  The statistics are frozen after training, so the exact code length of
every byte in every context is a table, laid out ``[context, byte, language]``, and a text is scored
by array look-ups.  The language with the shortest code wins; the score is its posterior among the
learned ones at equal priors.

Texts are lower-cased and everything but letters and non-ASCII bytes becomes one space, so that
digits, symbols and shouting do not count.

The trees are fitted on a bounded sample: per language, documents with something to learn are taken
in the order of a hash of id and text until ``SAMPLE_DOCS`` documents or ``SAMPLE_BYTES`` bytes are
reached.  Of a long document the fit reads the first ``SAMPLE_BYTES / LEAST_DOCS`` bytes of letters, so
``LEAST_DOCS`` documents always fit in and no language is left out.  The counts are made and summed in
Spark.  Every context of the sample is kept: languages whose tables together exceed ``TABLE_BYTES`` go
out in several broadcasts (one language always in one), and a worker holds one of them at a time.

Definitions for odd input: text that is NULL or has no letter is ``und`` with score 0, and so is
all text if nothing was learned; rows without text or language teach nothing; equally short codes
go to the language that sorts first; repeated rows are predicted alike and teach once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import fold_of, slices, table

ORDER = 3
SAMPLE_DOCS = 400
SAMPLE_BYTES = 2 << 20
LEAST_DOCS = 40  # so many documents fit into SAMPLE_BYTES, however long they are
TABLE_BYTES = 48 << 20
STEP = 1 << 20  # places scored at once
LETTER = regex.compile(r"\p{L}")
TEACHES = r"[A-Za-z\x{80}-\x{10FFFF}]"  # in Java: ``plain_bytes`` leaves something
HASHES = 1 << 62
PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
GAP = b"\x00" * ORDER  # before each text: no context reaches over it


def plain_bytes(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(PLAIN).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def joined(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each (with its gap) begins."""
    parts = [GAP + plain_bytes(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1]
    return np.frombuffer(b"".join(parts), np.uint8), starts


class Model:
    """``costs[row, symbol, language]`` in bits; ``rows[packed context]``: the longest known one."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        seen = np.zeros(256, bool)
        for packed, _ in grams.values():
            seen[packed & 255] = True
        seen[0] = False
        self.symbols = np.zeros(256, np.int64)  # 0 is the gap
        self.symbols[seen] = np.arange(1, seen.sum() + 1)
        unknown = int(seen.sum()) + 1
        self.symbols[~seen] = unknown
        self.symbols[0] = 0
        self.size = a = unknown + 1
        counts = []
        for lang in langs:
            packed, n = grams[lang]
            s = [self.symbols[(packed >> shift) & 255] for shift in (24, 16, 8, 0)]
            real = s[3] > 0
            counts.append(([x[real] for x in s], n[real].astype(float)))
        made = np.zeros((1, a, len(langs)))
        made[:, 1:, :] = 1 / 256  # below the empty context
        costs, rows = made, np.zeros(1, np.int64)
        for order in range(ORDER + 1):
            total, found = np.zeros(a**order), []
            for s, n in counts:
                usable = np.all([x > 0 for x in s[3 - order : 3]], axis=0) & (n > 0)
                key = _pack([x[usable] for x in s[3 - order : 3]], a, int(usable.sum()))
                found.append((key, s[3][usable], n[usable]))
                np.add.at(total, key, n[usable])
            known = np.flatnonzero(total)
            place = np.full(a**order, -1)
            place[known] = np.arange(len(known))
            shorter = rows[np.arange(a**order) % a ** max(0, order - 1)]
            made = np.zeros((len(known), a, len(langs)))
            for j, (key, symbol, n) in enumerate(found):
                here = place[key] >= 0
                c = np.zeros((len(known), a))
                np.add.at(c, (place[key[here]], symbol[here]), n[here])
                made[:, :, j] = _escape(c, costs[shorter[known], :, j])
            rows = np.where(place >= 0, len(costs) + place, shorter)
            costs = np.concatenate((costs, made))
        costs = -np.log2(np.maximum(costs, 1e-30))
        costs[:, 0, :] = 0
        self.costs = costs.astype(np.float32).reshape(-1, len(langs))
        self.rows = rows.astype(np.int32)

    def state(self) -> dict:
        """Plain values to broadcast."""
        return dict(vars(self))

    @classmethod
    def of(cls, state: dict) -> Model:
        model = cls.__new__(cls)
        vars(model).update(state)
        return model

    def code_lengths(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per text and language; bytes coded per text."""
        data, starts = joined(texts)
        bits = np.zeros((len(texts), len(self.langs)))
        a = self.size
        for at in range(0, len(data), STEP):
            s = self.symbols[data[max(0, at - ORDER) : at + STEP]]
            lead = min(at, ORDER)
            s = np.concatenate((np.zeros(ORDER - lead, np.int64), s))
            context = (s[:-3] * a + s[1:-2]) * a + s[2:-1]
            cost = self.costs[self.rows[context].astype(np.int64) * a + s[3:]]
            i = int(np.searchsorted(starts, at, "right")) - 1
            j = int(np.searchsorted(starts, at + len(cost), "left"))
            cuts = np.maximum(starts[i:j] - at, 0)
            bits[i:j] += np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)
        ends = np.append(starts[1:], len(data))
        return bits, ends - starts - ORDER


def _pack(symbols: list[np.ndarray], a: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for s in symbols:
        out = out * a + s
    return out


def _escape(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probability of a byte of each symbol, given the counts here and the shorter context's ones."""
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    rest = 1 - np.where(counts > 0, lower, 0).sum(1, keepdims=True)
    escape = np.divide(kinds, total + kinds, out=np.ones_like(total), where=total > 0)
    here = np.divide(counts, total + kinds, out=np.zeros_like(counts), where=total > 0)
    under = escape * lower / np.maximum(rest, 1e-9)
    return np.where(total > 0, np.where(counts > 0, here, under), lower)


def _grams(most: int):
    """(lang, packed bytes of context and next byte, count), from ``most`` bytes of a text."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            texts, langs = piece.column("text").to_pylist(), piece.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                data = b"".join(GAP + plain_bytes(t)[:most] for t, x in zip(texts, langs, strict=True) if x == lang)
                b = np.concatenate((np.zeros(ORDER, np.uint32), np.frombuffer(data, np.uint8).astype(np.uint32)))
                packed, n = np.unique(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n)), pa.array(packed.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                )

    return work


Grams = dict[str, tuple[np.ndarray, np.ndarray]]


def _table_bytes(grams: Grams) -> int:
    """Bytes of the tables of a ``Model`` of these languages."""
    packed = np.unique(np.concatenate([p for p, _ in grams.values()]).astype(np.int64))
    packed = packed[packed & 255 > 0]
    a = len(np.unique(packed & 255)) + 2
    rows = 1
    for order in range(ORDER + 1):
        inner = [(packed >> 8 * i) & 255 > 0 for i in range(1, order + 1)]
        whole = packed[np.all(inner, axis=0)] if inner else packed
        rows += len(np.unique((whole >> 8) & ((1 << 8 * order) - 1)))
    return rows * a * len(grams) * 4 + a**ORDER * 4


def _blocks(grams: Grams) -> list[Grams]:
    """The languages in order, as many together as ``TABLE_BYTES`` holds, but one at least."""
    out: list[Grams] = []
    for lang in sorted(grams):
        more = {**out[-1], lang: grams[lang]} if out else {}
        if more and _table_bytes(more) <= TABLE_BYTES:
            out[-1] = more
        else:
            out.append({lang: grams[lang]})
    return out


def _limits(rows: DataFrame) -> dict[str, int]:
    """Per language the largest hash in its sample."""
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    cuts = {r.lang: min(HASHES, HASHES * 2 * SAMPLE_DOCS // r.n) for r in sizes}
    most, out = SAMPLE_BYTES // LEAST_DOCS, {}
    while cuts:  # again only for languages of mostly repeated rows or rows that teach nothing
        cut = _by_lang(cuts)
        found: dict[str, list[tuple[int, int]]] = {x: [] for x in cuts}
        near = rows.where(F.col("h") < cut[F.col("lang")]).where(F.col("text").rlike(TEACHES))
        for r in near.groupBy("lang", "h").agg(F.min(F.least(F.octet_length("text"), F.lit(most))).alias("b")).collect():
            found[r.lang].append((r.h, r.b))
        for lang, drawn in found.items():
            if len(drawn) < SAMPLE_DOCS and cuts[lang] < HASHES:
                cuts[lang] = min(HASHES, cuts[lang] * 16)
                continue
            del cuts[lang]
            total = 0
            for h, b in sorted(drawn)[:SAMPLE_DOCS]:
                total += b
                if total > SAMPLE_BYTES:
                    break
                out[lang] = h
    return out


def _by_lang(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x).cast("long") if i else F.lit(x) for item in values.items() for i, x in enumerate(item)))


def train(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[Grams] | None:
    """Count the trees of each block of languages; None if no row has something to learn and a language."""
    rows = labelled.select(
        F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(HASHES)).alias("h"),
        F.col(f"`{lang}`").cast("string").alias("lang"),
        F.col(f"`{text}`").cast("string").alias("text"),
    ).where("lang is not null and text is not null")
    limits = _limits(rows)
    if not limits:
        return None
    counted = (
        rows.where(F.col("h") <= _by_lang(limits)[F.col("lang")])
        .where(F.col("text").rlike(TEACHES))
        .groupBy("lang", "h")
        .agg(F.min("text").alias("text"))
        .select("lang", "text")
        .mapInArrow(_grams(SAMPLE_BYTES // LEAST_DOCS), "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    name = np.array(counted.column("lang").to_pylist(), object)
    gram, n = counted.column("gram").to_numpy(), counted.column("n").to_numpy()
    return _blocks({x: (gram[name == x], n[name == x]) for x in limits})


def predict(
    docs: DataFrame, blocks: list[Grams] | None, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """``keep`` and lang_pred, score (posterior), bits_per_byte (NULL for ``und``)."""
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(Model([*b], b).state()) for b in blocks or ()]
    source = docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").cast("string").alias("__text"))

    def models() -> Iterator[Model]:
        for block in shared:
            yield Model.of(block.value)
            if len(shared) > 1:
                del block._value  # read again for the next texts

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "__text"):
            texts = piece.column("__text").to_pylist()
            names, scores, per_byte = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            spoken = [i for i, t in enumerate(texts) if has_letter(t)]
            if shared and spoken:
                langs, parts = [], []
                for model in models():
                    bits, n = model.code_lengths([texts[i] for i in spoken])
                    langs += model.langs
                    parts.append(bits)
                    del model
                bits = np.concatenate(parts, axis=1)
                best = bits.argmin(1)
                odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                for i, b, o, row, m in zip(spoken, best, odds, bits, n, strict=True):
                    names[i], scores[i], per_byte[i] = langs[b], 1 / o, row[b] / max(1, m)
            made = [pa.array(names), pa.array(scores), pa.array(per_byte, pa.float64())]
            kept = [piece.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, "lang_pred", "score", "bits_per_byte"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(work, types + "lang_pred string, score double, bits_per_byte double")


def held_out(doc_id: str = "doc_id") -> Column:
    return fold_of(doc_id, 5) == 0


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
