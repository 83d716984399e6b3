"""The registered queries of the subpackage against their SQL."""

from __future__ import annotations

import pytest

from millrace.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.test_oracles import ordered


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert ordered(df.select(*columns).collect()) == ordered([tuple(r[i] for i in places) for r in answer.fetchall()])


def test_all_operators():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
