from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from millrace.llm import ppm
from tests.llm.cases import SCHEMA, row, table_of, texts


def grams_of(text: str):
    data, _ = ppm.joined([text])
    b = np.concatenate((np.zeros(3, np.uint32), data.astype(np.uint32)))
    return np.unique(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:], return_counts=True)


def plain_bits(train: str, text: str) -> float:
    """Escape method C with exclusion, byte by byte."""
    data = ppm.plain_bytes(train)
    counts: dict[bytes, Counter] = {}
    for i, b in enumerate(data):
        for order in range(4):
            if i >= order:
                counts.setdefault(data[i - order : i], Counter())[b] += 1
    bits, data = 0.0, ppm.plain_bytes(text)

    def prob(context: bytes | None, b: int) -> float:
        if context is None:
            return 1 / 256
        shorter = context[1:] if context else None
        c = counts.get(context)
        if not c:
            return prob(shorter, b)
        n, d = sum(c.values()), len(c)
        if b in c:
            return c[b] / (n + d)
        return d / (n + d) * prob(shorter, b) / (1 - sum(prob(shorter, x) for x in c))

    for i, b in enumerate(data):
        bits -= math.log2(prob(data[max(0, i - 3) : i], b))
    return bits


def test_exact_code_lengths():
    train = "the cat sat on the mat that the rat sat at. ça été là"
    model = ppm.Model(["x"], {"x": grams_of(train)})
    for text in ("the cat", "zebra quux", "th", "été ça va", train):
        bits, n = model.code_lengths([text])
        assert n[0] == len(ppm.plain_bytes(text))
        assert bits[0, 0] == pytest.approx(plain_bits(train, text), rel=1e-4)


def test_texts_longer_than_a_step(monkeypatch):
    model = ppm.Model(["x"], {"x": grams_of("one two three four five six seven")})
    sample = ["one two " * 50, "", "seven", "three " * 40]
    whole, _ = model.code_lengths(sample)
    monkeypatch.setattr(ppm, "STEP", 17)
    parts, _ = model.code_lengths(sample)
    assert np.allclose(whole, parts, rtol=1e-5)


def test_odd_rows(spark):
    docs = table_of(spark)
    found = [(r.doc_id, r.lang_pred, r.score) for r in ppm.predict(docs, ppm.train(docs)).collect()]
    by = {d: (p, s) for d, p, s in found}
    assert len(found) == len(texts())
    for doc in (4, 5, 9, 12):
        assert by[doc] == ("und", 0.0)
    assert by[11][0] == "fr" and by[1][0] == "en" and all(0 <= s <= 1 for _, s in by.values())


def test_nothing_learned(spark):
    docs = table_of(spark)
    assert ppm.train(spark.createDataFrame([], SCHEMA)) is None
    assert {r.lang_pred for r in ppm.predict(docs, None).collect()} == {"und"}
    assert ppm.predict(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.001"
    got = ppm.op8_language(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    rows = got.select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


WORDS = {x: [f"{x}{y}{z}" for y in "aeiou" for z in x + "rst"] for x in ("ba", "ce", "di", "fo", "gu", "hy")}


def spoken(lang: str, at: int, n: int) -> str:
    return " ".join(WORDS[lang][(at * 7 + i * i) % len(WORDS[lang])] for i in range(n))


def test_one_long_document_starves_no_language(spark, monkeypatch):
    monkeypatch.setattr(ppm, "SAMPLE_BYTES", 4096)
    rows = []
    for k, lang in enumerate(WORDS):
        rows.append(row(k * 1000, spoken(lang, 1, 100_000), lang))
        rows += [row(k * 1000 + i, spoken(lang, i, 40), lang) for i in range(1, 101)]
        rows += [row(None, "12 34", lang)] * 2000
    docs = table_of(spark, rows)
    found = ppm.predict(docs.where("text <> '12 34'"), ppm.train(docs), keep=("doc_id", "lang")).collect()
    assert len(found) == 606 and all(r.lang_pred == r.lang for r in found)


def test_small_tables_keep_every_context(spark, monkeypatch):
    rows = [row(k * 1000 + i, spoken(lang, i, 40), lang) for k, lang in enumerate(WORDS) for i in range(30)]
    docs = table_of(spark, rows)
    result = lambda: sorted((r.doc_id, r.lang_pred, r.score, r.bits_per_byte) for r in ppm.predict(docs, ppm.train(docs)).collect())
    whole = result()
    monkeypatch.setattr(ppm, "TABLE_BYTES", 1 << 14)
    parts = result()
    assert [r[:2] for r in parts] == [r[:2] for r in whole]
    assert np.allclose([r[2:] for r in parts], [r[2:] for r in whole])
