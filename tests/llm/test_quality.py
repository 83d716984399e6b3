from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import quality
from tests.llm.cases import SCHEMA, WORDS, table_of, texts


def plain(text):
    text = text or ""
    w = WORDS.findall(text)
    runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {i for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


MORE = ["a b c d e f g h a b c d e f g h", "x " * 40, "one\none\n \n two \n two \none", "# * $ % & | < > a", "p q r s t u v w x p q r s t u v w y " + "z1 z2 z3 " * 3]


def test_base_counts(spark):
    rows = texts() + [(100 + i, t, "en", "s", None, "x", "k", 7, "w", "i", 3, "t") for i, t in enumerate(MORE)]
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.assess(table_of(spark, rows)).collect())
    assert got == sorted((r[0] or 0, *plain(r[1])) for r in rows)


def test_distance(spark):
    def jsd(p, q):
        kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
        m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
        return math.sqrt((kl(p, m) + kl(q, m)) / 2)

    pairs = [([0.5, 0.5, 0.0], [0.1, 0.2, 0.7]), ([1.0, 0.0], [0.0, 1.0]), ([0.3, 0.7], [0.3, 0.7])]
    df = spark.createDataFrame(pairs, "p array<double>, q array<double>").select(quality.distance(F.col("p"), F.col("q")).alias("d"))
    assert [r.d for r in df.collect()] == pytest.approx([jsd(*x) for x in pairs], abs=1e-9)


def test_junk_goes_and_prose_stays(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.op1_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, junk = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(junk) <= 0.1 * len(junk)


def test_no_python_in_the_plan(spark):
    plan = quality.assess(table_of(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_nothing_to_learn_from(spark):
    assert quality.assess(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = table_of(spark, [(1, "word " * 30 + "and more of it", None, *[None] * 9)])
    (r,) = quality.assess(alone).collect()
    assert r.kept == (not r.base_failed) and r.class_distance is None
