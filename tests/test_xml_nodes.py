"""Nested XML against a plain walk."""

from __future__ import annotations

import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from millrace.sources import xml_nodes


def plain(doc, content):
    out, count = [], [0]

    def walk(elem, parent, level, path):
        pre, path = count[0], f"{path}/{elem.tag}"
        count[0] += 1
        for child in elem:
            walk(child, pre, level + 1, path)
        out.append((doc, pre, count[0] - 1, parent, level, path, elem.tag, tuple(sorted(elem.attrib.items())), (elem.text or "").strip()))

    walk(ET.fromstring(content), None, 0, "")
    return out


def random_xml(pick, depth=0):
    inner = "".join(
        random_xml(pick, depth + 1) if pick.random() < 0.7 else pick.choice(["tail", " é &amp; ", "<![CDATA[<b>]]>", "<!-- c -->"])
        for _ in range(pick.randrange(0, 6 - depth) if depth < 5 else 0)
    )
    tag = pick.choice("abcd")
    return f"<{tag} {pick.choice(['', 'x=\"1\"', 'x=\"&lt;\" y=\"ü\"'])}>{pick.choice(['', ' t ', 'text'])}{inner}</{tag}>"


def test_like_a_plain_walk(spark, monkeypatch):
    pick = random.Random(2)
    docs = [(f"d{i}", random_xml(pick).encode()) for i in range(40)]
    docs.append(("ns", b'<r xmlns="urn:a" xmlns:p="urn:b"><p:c p:k="v">1</p:c></r>'))
    docs.append(("wide", b"<r>" + b"<i>7</i>" * 20_000 + b"</r>"))
    df = spark.createDataFrame(docs, "path string, content binary").repartition(5)
    monkeypatch.setattr(xml_nodes, "CHUNK", 37_001)
    table = xml_nodes.nodes(df)
    got = {(r.doc, r.pre, r.last, r.parent, r.level, r.path, r.tag, tuple(sorted(r.attributes.items())), r.text) for r in table.collect()}
    want = [n for d, c in docs for n in plain(d, c)]
    assert got == set(want) and table.count() == len(want)
    tops = table.where("tag = 'a'").select("doc", "pre", "last")
    pairs = xml_nodes.inside(table, tops).select("doc", "pre", "top_pre").collect()
    spans = [(w[0], w[1], w[2]) for w in want if w[6] == "a"]
    assert sorted(map(tuple, pairs)) == sorted((w[0], w[1], p) for d, p, e in spans for w in want if w[0] == d and p < w[1] <= e)


def test_damaged_and_empty(spark):
    rows = [("cut", b"<a><b>1</b><c>"), ("empty", b""), ("null", None), ("text", b"no xml"), ("ok", b"<a/>")]
    got = xml_nodes.nodes(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {(r.doc, r.tag, r.text) for r in got if r.error is None} == {("cut", "b", "1"), ("ok", "a", "")}
    assert sorted(r.doc for r in got if r.error) == ["cut", "empty", "null", "text"]
    none = spark.createDataFrame([], "path string, content binary")
    assert xml_nodes.nodes(none).where(F.col("tag").isNotNull()).count() == 0
