from __future__ import annotations

import hashlib

import numpy as np

from millrace.llm import line_dedup
from millrace.llm.line_dedup import Cuckoo, LineIndex
from tests.llm.cases import SCHEMA, lower, row, table_of, texts


def plain(rows):
    holders: dict[str, set] = {}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if r[0] is not None and len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(r[0])
    out = []
    for r in rows:
        all_lines = (r[1] or "").split("\n")
        left = [x for x in all_lines if r[0] is None or len(own := holders.get(key(x), ())) < 2 or min(own) == r[0]]
        out.append((r[0] or 0, len(all_lines), len(all_lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def test_brute_force(spark):
    assert rows_of(line_dedup.dedup(table_of(spark))) == plain(texts())


def test_without_filters(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)
    assert rows_of(line_dedup.dedup(table_of(spark))) == plain(texts())


def test_insert_and_delete_are_reversible(spark):
    first, second = texts()[:3], texts()[3:] + [row(20, "A shared line of text.")]
    small = table_of(spark, first)
    index = LineIndex.build(small)
    both = index.insert(table_of(spark, second))
    everything = table_of(spark, first + second)
    assert rows_of(both.clean(everything)) == plain(first + second)
    back = both.delete(spark.createDataFrame([(r[0],) for r in second], "doc_id long"))
    state = lambda i: sorted(map(tuple, i.counts.select("hi", "lo", "refs", "first_doc", "last_doc").collect()))
    assert state(back) == state(index)
    assert rows_of(back.clean(small)) == plain(first)
    # without the first holder the second keeps the line
    later = both.delete(spark.createDataFrame([(1,)], "doc_id long"))
    left = [r for r in first + second if r[0] != 1]
    assert rows_of(later.clean(table_of(spark, left))) == plain(left)


def test_full_filters_are_rebuilt(spark):
    line = lambda i: f"shared line number {i}"
    index = LineIndex.build(table_of(spark, [row(1, line(0)), row(2, line(0))]))
    many = [row(d, "\n".join(map(line, range(300)))) for d in (3, 4)]
    grown = index.insert(table_of(spark, many))
    assert grown.filters.where("cells is null").isEmpty()
    assert rows_of(grown.clean(table_of(spark, many)))[1][2] == 300


def test_cuckoo_filter():
    pick = np.random.default_rng(5)
    keys = pick.integers(-(2**63), 2**63 - 1, (4000, 2), dtype=np.int64)
    cuckoo = Cuckoo(4000)
    assert cuckoo.insert(keys[:3000, 0], keys[:3000, 1])
    assert cuckoo.has(keys[:3000, 0], keys[:3000, 1]).all()
    assert cuckoo.has(keys[3000:, 0], keys[3000:, 1]).mean() < 0.01
    cuckoo.delete(keys[:1500, 0], keys[:1500, 1])
    assert cuckoo.has(keys[1500:3000, 0], keys[1500:3000, 1]).all()
    assert cuckoo.has(keys[:1500, 0], keys[:1500, 1]).mean() < 0.01
    assert not Cuckoo(4).insert(keys[:200, 0], keys[:200, 1])


def test_empty_table(spark):
    assert line_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
