from __future__ import annotations

import random

import numpy as np

from millrace.llm import hyperminhash as hmh
from tests.llm.cases import SCHEMA, row, table_of, texts, words


def shingles(text, width=4):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def plain(rows, width=4):
    sets = [(r[0], shingles(r[1], width)) for r in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i or 0, len(s), find(i) or 0, i == find(i)) for i, s in sets)


def rows_of(df):
    return sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in df.collect())


def copies(n=60):
    """A group whose members differ so much that not all are linked, near misses, and tiny sets."""
    pick = random.Random(11)
    base = [f"w{i}" for i in range(140)]
    out = []
    for i in range(n):
        text = list(base)
        for k in pick.sample(range(140), pick.randint(0, 9)):
            text[k] = f"x{pick.randrange(10**6)}"
        out.append(row(100 + i, " ".join(text)))
    tiny = [f"t{i}" for i in range(8)]
    for i in range(10):
        text = list(tiny)
        if i % 3:
            text[-1] = f"u{i % 3}"
        out.append(row(300 + i, " ".join(text)))
    return out


def test_brute_force(spark, monkeypatch):
    rows = texts() + copies()
    want = plain(rows)
    assert rows_of(hmh.near_duplicates(table_of(spark, rows))) == want
    assert len({w[2] for w in want if 100 <= w[0] < 160}) > 1  # the group is not one component
    monkeypatch.setattr(hmh, "CELL", 3)  # many cells
    monkeypatch.setattr(hmh, "FILTER_BYTES", -1)  # sets found by a join
    assert rows_of(hmh.near_duplicates(table_of(spark, rows))) == want


def test_given_documents_with_five_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(hmh.near_duplicates(docs, width=5)) == plain(rows, 5)


def test_registers_agree_as_often_as_sets_do():
    pick = np.random.default_rng(2)
    for size, share in ((2000, 0.8), (2000, 0.5), (40, 0.8), (40, 0.2)):
        found = []
        for _ in range(60):
            both = round(size * share)
            pool = pick.integers(0, 2**63, 2 * size - both, dtype=np.uint64)
            a, b = np.unique(pool[:size]), np.unique(np.concatenate((pool[:both], pool[size:])))
            (ra, _), (rb, _) = hmh.registers(a), hmh.registers(b)
            found.append(hmh.estimate(ra, rb))
        assert abs(np.mean(found) - both / len(pool)) < 0.03
    full, filled = hmh.registers(np.unique(pick.integers(0, 2**63, 5000, dtype=np.uint64)))
    assert filled == hmh.BUCKETS and (full >> hmh.MANTISSA).min() >= 1
    assert hmh.hopeless(full, full[::-1].copy(), filled, 80) and not hmh.hopeless(full, full, filled, 80)


def test_bands_find_similar_sets():
    pick = np.random.default_rng(4)
    missed = 0
    for _ in range(400):
        size = int(pick.integers(5, 300))
        both = -(-8 * size // 9)  # J = both / (2 size - both) >= 0.8
        pool = pick.integers(0, 2**63, 2 * size - both, dtype=np.uint64)
        a, b = np.unique(pool[:size]), np.unique(np.concatenate((pool[:both], pool[size:])))
        keys = [hmh.band_keys(hmh.registers(x)[0]) for x in (a, b)]
        missed += not np.isin(*keys).any()
    assert missed == 0


def test_empty_table(spark):
    assert hmh.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
