from __future__ import annotations

import hashlib
import re

from millrace.llm import decontaminate
from tests.llm.cases import LONG, PROSE, SCHEMA, lower, table_of, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, PROSE),
    (2, "short"),
    (10, "Zürich, ÉTÉ"),
    (3, None),
    (4, ""),
    (5, "something ELSE entirely; told in other words than before!"),
    (5, "x-y-z"),
    (6, " ".join(LONG.split()[40:70])),
    (7, "never seen anywhere in these documents by any chance at all, surely"),
]
ITEM_SCHEMA = "item_id long, text string"


def plain(rows, items, window=10):
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = []
    for r in rows:
        w, hit, found = WORD.findall(lower(r[1])), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((r[0] or 0, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_brute_force_in_one_block_and_in_many(spark):
    docs, items = table_of(spark), spark.createDataFrame(ITEMS, ITEM_SCHEMA)
    want = plain(texts(), ITEMS)
    assert rows_of(decontaminate.digests(docs, items)) == want
    assert rows_of(decontaminate.digests(docs, items, block_bytes=200)) == want


def test_spans_point_into_the_original(spark):
    text = "Ça: the CAT -- sat… then éé the cat, sat."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the cat sat")], ITEM_SCHEMA)
    (r,) = decontaminate.scan(docs, items).collect()
    # the ellipsis is part of the first word ``sat…``, so only the second place counts
    assert [text[s.start : s.end] for s in r.spans] == ["the cat, sat"]


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame(ITEMS, ITEM_SCHEMA)
    assert decontaminate.digests(none, items).count() == 0
    got = decontaminate.digests(table_of(spark), spark.createDataFrame([], ITEM_SCHEMA)).collect()
    assert len(got) == len(texts()) and not any(r.contaminated for r in got)
