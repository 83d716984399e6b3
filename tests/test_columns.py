"""Column helpers on literal edge values."""

from __future__ import annotations

import html

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import parse, text
from millrace.functions.html import html_to_text
from millrace.operators import names


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r[1] for r in df.select("i", make(F.col("v"))).orderBy("i").collect()]


def test_numbers(spark):
    texts = ["1,234.5", " 7 ", "5d", "inf", "1.2.3", "(3)", "-2e3", "", None, ".5", "1 2"]
    want = [1234.5, 7.0, None, None, None, None, -2000.0, None, None, 0.5, None]
    assert values(spark, texts, parse.to_number) == want


def test_looks_numeric_counts_versions_as_numbers(spark):
    texts = ["1.2.3", "2024.01.02", "1,2", "-5", "5-", "a1", "."]
    want = [True, True, True, True, False, False, False]
    assert values(spark, texts, parse.digits_only) == want


def test_fractions_and_amounts(spark):
    texts = ["12.5%", "12,5%", "7", "1.2.3%", "%", None]
    assert values(spark, texts, parse.to_fraction) == [0.125, 0.125, 0.07, None, None, None]
    texts = ["$1,234.50", "€ 3", "4 £", "₹", "($3)", "5d", None]
    assert values(spark, texts, parse.to_amount) == [1234.5, 3.0, 4.0, None, None, None, None]


def test_booleans(spark):
    texts = [" TRUE ", "y", "1", "No", "f", "maybe", None]
    assert values(spark, texts, parse.to_bool) == [True, True, True, False, False, None, None]


def test_placeholders_are_exact(spark):
    texts = ["n/a", "N/A", "None", "none", "NULL", "nan", "-", "NA", None]
    want = [None, "N/A", "None", None, None, None, None, "NA", None]
    assert values(spark, texts, text.null_if_placeholder) == want


def test_white_space_is_unicode(spark):
    texts = ["\t a  b\n", "﻿x​y", "　z "]
    assert values(spark, texts, text.tidy_text) == ["a b", "xy", "z"]
    assert values(spark, texts, text.strip_space) == ["a  b", "﻿x​y", "z"]


def test_json_shape(spark):
    texts = [' {"a": 1} ', "[1]", "{]", "x", None]
    assert values(spark, texts, text.looks_like_json) == [True, True, False, False, None]


def test_times(spark):
    texts = ["2024-02-30", "2024-2-3", "3-MEDIUM", "2024-02-03", None]
    got = values(spark, texts, lambda c: parse.to_time(c, "yyyy-M-d").cast("string"))
    assert got == [None, "2024-02-03 00:00:00", None, "2024-02-03 00:00:00", None]
    mixed = ["03/04/2024", "2024/05/06", "2024-01-02T03:04:05Z", "04-Mar-2024", "soon"]
    got = values(spark, mixed, lambda c: parse.to_time_mixed(c).cast("string"))
    assert got[:2] == ["2024-03-04 00:00:00", "2024-05-06 00:00:00"]
    assert got[2:] == ["2024-01-02 03:04:05", "2024-03-04 00:00:00", None]


@pytest.mark.parametrize("all_entities", [True, False])
def test_html(spark, all_entities):
    page = "<p>a &amp;lt; b</p><script>x</script><!-- <b>no</b> --><STYLE>y</STYLE>&copy;"
    assert values(spark, [page], lambda c: html_to_text(c, all_entities)) == ["a &lt; b©"]


def test_html_rare_entities(spark):
    texts = ["<b>&eacute;&#8364;&amp;amp;</b>", "plain &amp; simple", None]
    got = values(spark, texts, html_to_text)
    assert got == [html.unescape("&eacute;&#8364;&amp;amp;"), "plain & simple", None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=60))
def test_text_steps_are_idempotent(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for step in (text.tidy_text, text.null_if_placeholder, text.keep_ascii, text.drop_invisible):
        once = values(spark, texts, step)
        assert values(spark, once, step) == once


def test_names():
    given_names = [" A b", "a-b", "A  B", "é!", "a_b"]
    assert names.tidy_names(given_names) == ["a_b", "a_b_2", "a_b_3", "é_", "a_b_4"]
    assert names.ids_first(["x", "order_id", "idle", "uuid"]) == ["order_id", "uuid", "x", "idle"]
