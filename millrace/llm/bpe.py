"""BPE encoding and decoding by a token automaton.

The merges are compiled, in rank order, into a deterministic automaton over tokens by one *merge
gadget* each.  It starts with a single state that loops on every byte symbol.  The gadget for the
merge ``u v -> w`` lets arc ``u`` enter a copy of its target from which arc ``v`` is gone, and adds
an arc ``w`` past both, wherever ``u v`` was a path.  All arcs with one label enter one state, so a
state is named by the token that enters it, and copying one is cheap: the copy keeps a pointer to
the state it was copied from and the rank up to which that state's losses count.  The paths of the
result are exactly the BPE tokenizations; every prefix of a word has exactly one.

Words are then read byte by byte with one table entry each.  For that the token automaton is turned into a deterministic
one over bytes, compiled entry by entry where words lead: its state is the longest suffix read so far that
a label can go on from, with the last token of every prefix that ends in it.  A transition finds the one arc that
ends behind the new byte.  The path is read back along the last tokens.  Decoding emits the labels of the arcs.

Definitions for odd input: NULL text is the empty text; empty text has no tokens; very long words
cost time in proportion to their length; rows are handled one by one, so repeated rows give
repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import per_process, slices, table

NEVER = 1 << 30
KNOWN_WORDS = 80_000  # words of one generation remembered per worker
KNOWN_ARCS = 100_000
KNOWN_STEPS = 400_000  # transitions of the byte automaton; beyond that it is compiled anew
SHORT = 64  # only words up to this many characters are remembered
# the space of the tokenizers library's patterns
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class TokenAutomaton:
    """The compiled automaton of one vocabulary with word-final symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.labels = {i: label for label, i in vocab.items()}
        self.lost: dict[tuple[int, int], int] = {}  # (state, arc) -> rank of the gadget that cut it
        self.left: dict[int, tuple[int, int]] = {}  # token -> (left part, rank)
        self.right: dict[int, tuple[int, int]] = {}  # token -> (right part, rank)
        self.arcs: dict[int, bool] = {}
        self.code = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        self.size: dict[int, int] = {}  # bytes that a token spells
        # the byte trie of the labels: depth, inner and word-final token per node
        self.goto: dict[int, int] = {}
        self.depth, self.inner, self.final = [0], [-1], [-1]
        base = set(self.code)
        alive = {i for t, i in vocab.items() if t in base or (t.endswith(end) and t[: -len(end)] in base)}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u in alive and v in alive and w not in alive and self._arc(u, v, rank):
                self._gadget(u, v, w, rank)
                alive.add(w)
        for label, i in vocab.items():
            if i in alive:
                final = label.endswith(end) and len(label) > len(end)
                spelled = bytes(map(self.code.__getitem__, label[: -len(end)] if final else label))
                self.size[i] = len(spelled)
                self._plant(spelled, i, final)
        self._link()
        self._forget()

    def _gadget(self, u: int, v: int, w: int, rank: int) -> None:
        self.lost[u, v] = rank
        self.left[w], self.right[w] = (u, rank), (v, rank)

    def _arc(self, state: int, token: int, before: int = NEVER) -> bool:
        """Whether ``state`` still has the arc ``token`` when the gadgets below ``before`` are in."""
        lost, left, right = self.lost, self.left, self.right
        s, s_until = state, before
        while True:
            t, t_until = token, before
            while True:
                rank = lost.get((s, t))
                if rank is not None and rank < s_until and rank <= t_until and rank < before:
                    return False
                if t not in left:
                    break
                t, t_until = left[t]
            if s not in right:
                return True
            s, s_until = right[s]

    def has_arc(self, state: int, token: int) -> bool:
        if state < 0:
            return True
        key = state << 20 | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= KNOWN_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._arc(state, token)
        return known

    def _plant(self, label: bytes, token: int, final: bool) -> None:
        node = 0
        for byte in label:
            key = node << 8 | byte
            if key not in self.goto:
                self.goto[key] = len(self.depth)
                self.depth.append(self.depth[node] + 1)
                self.inner.append(-1)
                self.final.append(-1)
            node = self.goto[key]
        (self.final if final else self.inner)[node] = token

    def _link(self) -> None:
        """Each trie node's longest proper suffix in the trie, and the longest suffix that a label goes on from."""
        children: list[list[tuple[int, int]]] = [[] for _ in self.depth]
        for key, node in self.goto.items():
            children[key >> 8].append((key & 255, node))
        self.fail, self.open = [0] * len(self.depth), [0] * len(self.depth)
        row = [0]
        while row:
            below = []
            for node in row:
                self.open[node] = node if children[node] else self.open[self.fail[node]]
                for byte, child in children[node]:
                    self.fail[child] = self._walk(self.fail[node], byte) if node else 0
                    below.append(child)
            row = below

    def _walk(self, node: int, byte: int) -> int:
        """The longest suffix of ``node`` and ``byte`` that is in the trie."""
        goto, fail = self.goto, self.fail
        while (found := goto.get(node << 8 | byte, -1)) < 0 and node:
            node = fail[node]
        return max(found, 0)

    def _forget(self) -> None:
        self.states = {(0, (-1,)): 0}
        self.views = [(0, (-1,))]
        self.last = [-1]
        self.steps: dict[int, int] = {}
        self.finals: dict[int, tuple[int, int]] = {}

    def _arrive(self, state: int, byte: int, ends: list[int]) -> tuple[int, int, tuple[int, ...]]:
        """(token, trie node, last tokens before): the one arc that ends behind ``byte``."""
        node, before = self.views[state]
        node = at = self._walk(node, byte)
        while at:
            token = ends[at]
            if token >= 0 and self.has_arc(before[self.depth[at] - 1], token):
                return token, node, before
            at = self.fail[at]
        raise ValueError(f"no token ends in byte {byte}")

    def _step(self, key: int) -> int:
        """A transition inside a word, compiled and entered in the table."""
        token, node, before = self._arrive(key >> 8, key & 255, self.inner)
        node = self.open[node]
        view = node, (token, *before[: self.depth[node]])
        state = self.states.setdefault(view, len(self.views))
        if state == len(self.views):
            self.views.append(view)
            self.last.append(token)
        self.steps[key] = state
        return state

    def _end(self, key: int) -> tuple[int, int]:
        """A transition with a word's last byte: its token and how many bytes that spells."""
        token, _, _ = self._arrive(key >> 8, key & 255, self.final)
        self.finals[key] = found = token, self.size[token]
        return found

    def spell(self, word: bytes) -> list[int]:
        """The arcs of the one path that spells ``word``: one table entry per byte, then back along the last tokens."""
        if not word:
            return []
        if len(self.steps) > KNOWN_STEPS:
            self._forget()
        steps, last, size, state, seen = self.steps, self.last, self.size, 0, []
        for byte in word[:-1]:
            key = state << 8 | byte
            state = steps.get(key, -1)
            if state < 0:
                state = self._step(key)
            seen.append(last[state])
        key = state << 8 | word[-1]
        token, width = self.finals.get(key) or self._end(key)
        out, at = [token], len(word) - width
        while at:
            token = seen[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def encode_word(self, word: str) -> list[int]:
        """The same for a word of byte symbols."""
        return self.spell(bytes(map(self.code.__getitem__, word)))


class Memory(dict):
    """Answers by word, in two generations: words not asked for while one fills up are forgotten."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= SHORT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Whole texts to ids and back, for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.auto = TokenAutomaton(model["vocab"], merges, end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = dict(self.auto.labels) | {i: s for s, i in self.special.items()}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.space = regex.compile(f"[{SPACE}]+")
        # the vocabulary's own pattern, with the library's notion of space spelled out
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        self.odd_space = regex.compile(r"[\x1c-\x1f]")  # space to str.split, not to the vocabulary
        self.known = Memory(self._pieces, KNOWN_WORDS)  # raw words
        self.spelled = Memory(self._spell, KNOWN_WORDS)  # pieces of normalised words

    def _spell(self, piece: str) -> bytes:
        return array("I", self.auto.spell(piece.encode("utf-8", "replace"))).tobytes()

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.spelled.__getitem__, self.words.findall(self.normal(text))))

    def normal(self, text: str) -> str:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()  # character by character: no final sigma

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" in text or self.odd_space.search(text):
            return b"".join(
                self.special[p].to_bytes(4, "little") if p in self.special else self._pieces(p)
                for p in self.parts.split(text)
            )
        return b"".join(map(self.known.__getitem__, text.split()))  # no piece holds space

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs with a space between them, as a vocabulary without decoder has it."""
        return " ".join(map(self.labels.__getitem__, memoryview(ids).cast("I")))


def codec(path: str) -> Codec:
    """Compiled once per worker process."""
    return per_process(("codec", path), lambda: Codec(path))


def _keep(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.select(*(F.col(f"`{n}`") for n in names))


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids`` (array of int) of every text."""
    return _run(df, path, text, keep, ids=True)


def round_trip(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ids_le`` (packed little-endian ids) and ``decoded`` of every text in one pass."""
    return _run(df, path, text, keep, ids=False)


def _run(df: DataFrame, path: str, text: str, keep: tuple[str, ...], ids: bool) -> DataFrame:
    source = df.select(*(F.col(f"`{n}`") for n in keep), F.col(f"`{text}`").cast("string").alias("__text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for piece in slices(batches, "__text"):
            packed = [tool.encode(t or "") for t in piece.column("__text").to_pylist()]
            kept = [piece.column(i) for i in range(len(keep))]
            if ids:
                made = [pa.array([list(memoryview(p).cast("I")) for p in packed], pa.list_(pa.int32()))]
            else:
                made = [pa.array(packed, pa.binary()), pa.array([*map(tool.decode, packed)], pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, *(("ids",) if ids else ("ids_le", "decoded"))])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(work, types + ("ids array<int>" if ids else "ids_le binary, decoded string"))


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``decoded`` of every list of ids; a NULL list is the empty one."""
    source = df.select(*(F.col(f"`{n}`") for n in keep), F.col(f"`{ids}`").alias("__ids"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = codec(path).labels
        for batch in batches:
            text = [" ".join(map(labels.__getitem__, x or ())) for x in batch.column("__ids").to_pylist()]
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string())], [*keep, "decoded"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(work, types + "decoded string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str, *more: str) -> DataFrame:
    """What the registered query returns of the round trip, and ``more`` of its columns."""
    return round_trip(docs, path).select(
        "doc_id",
        (F.length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"), vocabulary())
