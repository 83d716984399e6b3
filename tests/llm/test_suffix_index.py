from __future__ import annotations

import hashlib
import pathlib
import random

import numpy as np

from millrace.llm import suffix_index as si
from tests.llm.cases import SCHEMA, row, table_of, texts


def plain(rows):
    first: dict[bytes, int] = {}
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for d, t in data:
        for k in range(len(t) - 49):
            if d is not None:
                first[t[k : k + 50]] = min(d, first.get(t[k : k + 50], d))
    out = []
    for d, t in data:
        hit = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 49):
            if d is not None and first[t[k : k + 50]] < d:
                hit[k : k + 50] = True
        kept = bytes(b for b, h in zip(t, hit, strict=False) if not h)
        out.append((d or 0, len(t), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def spliced():
    """Parts of other documents side by side, cut anywhere; runs of one byte; repeats inside a document."""
    pick = random.Random(6)
    source = ["".join(pick.choice("abcdefgh ") for _ in range(400)) for _ in range(4)]
    out = []
    for d in range(40):
        parts = []
        for _ in range(pick.randint(1, 6)):
            s, a = pick.choice(source), pick.randrange(350)
            parts.append(s[a : a + pick.choice((20, 49, 50, 51, 60, 75, 120))] if pick.random() < 0.7 else "".join(pick.choice("xyz") for _ in range(30)))
        out.append(row(1000 - d * 7, "".join(parts)))
    out += [row(2000, "a" * 200), row(2001, "a" * 49), row(2002, "a" * 50), row(2003, "b" * 30 + "a" * 80), row(2004, "\x00" * 90), row(2005, "z" + "\x00" * 60)]
    out += [row(2006, source[0] * 3), row(2007, "é" * 60), row(2008, "x" + "é" * 40)]
    return out


def test_brute_force(spark):
    rows = texts() + spliced()
    assert rows_of(si.remove_repeats(table_of(spark, rows))) == plain(rows)


def test_small_pieces_and_shards(spark, monkeypatch):
    monkeypatch.setattr(si, "SHARD_BYTES", 4096)
    rows = texts()[:4] + spliced()
    assert rows_of(si.remove_repeats(table_of(spark, rows))) == plain(rows)


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    pick = random.Random(9)
    text = "".join(pick.choice("abcdef") for _ in range(5000)).encode()
    collect = lambda: sorted({(int(d), int(p), int(h)) for _, ds, ps, hs in si._found([(1, text), (2, text[:300])]) for d, p, h in zip(ds, ps, hs, strict=True)})
    whole = collect()
    monkeypatch.setattr(si, "CHUNK", 257)
    assert collect() == whole
    gaps = np.diff(sorted(p for d, p, _ in whole if d == 1))
    assert gaps.max() <= si.SPAN and 8 < len(text) / len(gaps) < 18


def test_batches_give_what_one_build_gives(spark):
    rows = spliced()
    one = si.indexable(table_of(spark, rows))
    built = si.SuffixIndex.build(si.indexable(table_of(spark, rows[:10])))
    for part in (rows[10:25], rows[25:]):
        built = built.insert(si.indexable(table_of(spark, part)))
    assert rows_of(si.cut(table_of(spark, rows), built.ranges(one))) == plain(rows)


def test_levels_grow_geometrically():
    pick = np.random.default_rng(3)
    sizes, moved, total = [], 0, 0
    for _ in range(400):
        n = int(pick.integers(50, 150))
        k = si.carried(sizes, n)
        made = n + sum(sizes[len(sizes) - k :])
        sizes, moved, total = [*sizes[: len(sizes) - k], made], moved + made * (k > 0), total + n
        assert all(a > si.GROWTH * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) <= 9
    assert sum(sizes) == total and moved < 12 * total


def test_order_and_packing():
    pick = np.random.default_rng(5)
    for wide in (50, 1 << 20):
        run = {k: pick.integers(0, wide, 3000).astype(t) for k, t in si.TYPES.items()}
        run["context"][::2] <<= np.uint64(40)
        got, order = si.ordered(run), np.lexsort((run["place"], run["doc"], run["context"], run["gram"]))
        assert all((got[k] == run[k][order]).all() for k in si.TYPES)
        assert all((si.unpack(si.pack(got))[k] == got[k]).all() for k in si.TYPES)


def _size(folder):
    return sum(f.stat().st_size for f in pathlib.Path(folder).glob("*.parquet"))


def test_an_insert_leaves_large_levels_alone(spark):
    pick = random.Random(8)
    docs = [row(i, "".join(pick.choice("abcdefgh ") for _ in range(3000))) for i in range(120)]
    late = [row(500, docs[3][1][100:700]), row(501, "".join(pick.choice("klm") for _ in range(2000)))]
    last = [row(-1, docs[7][1][:400])]  # a smaller id: older documents become repeats
    first = si.SuffixIndex.build(si.indexable(table_of(spark, docs)))
    second = first.insert(si.indexable(table_of(spark, late)))
    assert second.levels[0] == first.levels[0] and len(second.levels) == 2
    old, new = _size(first.levels[0][0]), _size(second.scans[-1])
    assert new < old / 4
    third = second.insert(si.indexable(table_of(spark, last)))
    assert third.levels[:1] == first.levels and sum(n for _, n in third.levels) > first.levels[0][1]
    for index, rows in ((first, docs), (second, docs + late), (third, docs + late + last)):
        frame = table_of(spark, rows)
        assert rows_of(si.cut(frame, index.ranges(si.indexable(frame)))) == plain(rows)


def test_empty_tables(spark):
    assert si.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    short = [row(1, "few"), row(2, None)]
    assert rows_of(si.remove_repeats(table_of(spark, short))) == plain(short)


def test_contexts_that_agree_in_32_bits(spark):
    """Two documents share one gram only; the hashes of what surrounds it agree in their lower half."""
    pick = np.random.default_rng(11)
    noise = pick.integers(97, 123, 1 << 18).astype(np.uint8)
    h = si.hashes(si.eights(noise), si.GRAM)
    gram = noise[h.argmin() :][: si.GRAM]  # an anchor wherever it stands
    n, size = 400_000, si.GRAM + 2 * si.REACH
    rows = pick.integers(97, 123, (n, size)).astype(np.uint8)
    rows[:, si.REACH : si.REACH + si.GRAM] = gram
    found = si.contexts({0: rows.tobytes()}, np.zeros(n, np.int64), np.arange(n) * size + si.REACH)
    low = found & np.uint64(0xFFFFFFFF)
    order = np.argsort(low, kind="stable")
    at = np.flatnonzero(low[order][1:] == low[order][:-1])
    assert len(at)
    pairs = []
    for i in at[:2]:
        for j in order[i : i + 2]:
            pairs.append(row(len(pairs), rows[j].tobytes().decode()))
    for a, b in zip(pairs[::2], pairs[1::2], strict=True):
        got = rows_of(si.remove_repeats(table_of(spark, [a, b])))
        assert got == plain([a, b]) and not any(r[2] for r in got)
