"""Every registered query against the same question in DuckDB."""

from __future__ import annotations

import math

import pytest

from queries import all_oracles, all_queries
from tests.conftest import DATA

QUERIES, ORACLES = all_queries(), all_oracles()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(value)
    return value if value is None or isinstance(value, (int, bool)) else str(value)


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.select(*(f"`{c}`" for c in columns)).collect()
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert ordered(got) == ordered([tuple(r[i] for i in places) for r in answer.fetchall()])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_has_rows(name, spark):
    assert QUERIES[name](spark, DATA).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
