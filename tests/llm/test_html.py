from __future__ import annotations

import html
import itertools
import re

import numpy as np
import pytest

from millrace.llm import html_crf
from millrace.llm.html_crf import Model, blocks, labelled, marginals, viterbi

WORDS = ("the quick brown fox jumps over a lazy dog while seven wizards quietly mix potions near old river banks " * 5).split()


@pytest.fixture(scope="module")
def model():
    m = Model()
    return m.fit([(m.features(f), marks) for f, marks in labelled(WORDS, 200)])


def test_blocks():
    page = """<html><head><title>t</title><style>p{}</style></head><body class='x Main-y'>stray <b>text</b><p>one&nbsp;&amp; two
      <br>three<p title="a>b">four<script>var x = "</p>";</script> five<ul><li>six<li>seven</ul><!-- <p>no</p> --><td>a&#233;</td><p></p><noscript>n</noscript>"""
    assert [b.text for b in blocks(page)] == ["stray text", "one & two three", "four", "five", "six", "seven", "aé"]
    assert blocks(page)[1].path == ("html", "body.main.x.y", "p")
    assert [(b.text, b.link) for b in blocks("<p>x <a href=1>link</a></p>")] == [("x link", 4)]
    assert blocks(None) == [] and blocks("") == [] and [b.text for b in blocks("plain < text")] == ["plain < text"]
    assert [b.text for b in blocks("<p>open <!-- never closed")] == ["open"]
    assert len(blocks("<div>" * 3000 + "deep")) == 1


def test_skipped_elements_end_where_they_end():
    said = lambda page: [b.text for b in blocks(page)]
    assert said("<p>one</p><svg/><p>two</p><p>three</p><svg><text>no</text></svg><p>four</p>") == ["one", "two", "three", "four"]
    assert said("<p>one</p><object data=x><p>two</p><p>three</p>") == ["one", "two", "three"]
    assert said("<p>a</p><object>no<object>no</object>no</object><p>b</p>") == ["a", "b"]
    assert said("<p>a<svg><g/><svg/><svg>no</svg>no</svg> b</p>") in (["a b"], ["a", "b"])
    assert said("<p>a</p><script>no") == ["a"] and said("<p>a</p><style>no<style>no</style><p>b</p>") == ["a", "b"]
    assert said("<p>a</p><script x='>' y=\"</script>\">no</script><p>b</p><svg-icon>c</svg-icon>") == ["a", "b", "c"]
    assert said("<svg>" * 20_000 + "<p>shown</p>") == ["shown"]


def test_viterbi_and_marginals_by_enumeration():
    pick = np.random.default_rng(1)
    unary, pairs = pick.normal(size=6), pick.normal(size=(2, 2))
    score = lambda y: sum(unary[i] for i in range(6) if y[i]) + sum(pairs[a, b] for a, b in itertools.pairwise(y))
    every = [*itertools.product((0, 1), repeat=6)]
    assert viterbi(unary.tolist(), pairs.tolist()) == list(max(every, key=score))
    weight = np.exp([score(y) for y in every])
    single, double = marginals(unary, pairs)
    assert single == pytest.approx((weight[:, None] * np.array(every)).sum(0) / weight.sum())
    both = np.zeros((2, 2))
    for y, w in zip(every, weight, strict=True):
        np.add.at(both, (np.array(y[:-1]), np.array(y[1:])), w / weight.sum())
    assert double == pytest.approx(both)


def test_held_out_layouts(model):
    pages = labelled(WORDS, 150, seed=99)
    right = sum(model.label(f) == marks for f, marks in pages)
    assert right >= 0.85 * len(pages)


def test_whole_articles_of_the_given_pages(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in html_crf.op4_html(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert got[r.page_id].text == "\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_pages(spark, model):
    page = "<article><p>" + "word " * 50 + ".</p></article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", page), (3, "u", page), (None, "u", "<nav><a href=1>x</a></nav>"), (5, "u", "<p>" + "long text, " * 50_000)]
    df = spark.createDataFrame([(*r, "t", 4) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = html_crf.extract(df, model).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id == 3] == [("word " * 50 + ".")] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (1, 2))
    none = df.where("page_id = 99")
    assert html_crf.train(none) is None and html_crf.extract(none, None).count() == 0
