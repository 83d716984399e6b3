"""Codes that grow, and plans that carry their code tables."""

from __future__ import annotations

import shutil

import pytest

from millrace.operators.codes import CodeBook
from millrace.plans import fit as fitting
from millrace.plans.config import CleanerConfig
from millrace.plans.fit import fit
from millrace.plans.growth import load_plan, save_plan, with_new_levels
from millrace.session import scratch_path

BATCHES = (["m", "c", None, "c", "x"], ["a", "m", "z", "z", None], ["b", "a", "y", "m"])
WANT = {"c": 0, "m": 1, "x": 2, "a": 3, "z": 4, "b": 5, "y": 6}


def test_three_batches_give_stable_codes(spark, frame):
    book, folder, seen = CodeBook(), scratch_path(spark, "codes"), []
    for batch in BATCHES:
        book = book.grown(frame("v string", *((b,) for b in batch)).repartition(3), "v", folder)
        seen.append({r.value: r.code for r in book.table(spark).collect()})
    assert seen[-1] == WANT and book.rows == 7 and len(book.parts) == 3
    assert all(small.items() <= WANT.items() for small in seen)
    assert book.grown(frame("v string", ("a",), (None,)), "v", folder) == book
    assert CodeBook().grown(frame("v string"), "v", folder).table(spark).count() == 0
    coded = book.encode(frame("v string", ("z",), ("new",), (None,)), "v", "code", unseen=99)
    assert {(r.v, r.code) for r in coded.collect()} == {("z", 4), ("new", 99), (None, None)}


def test_an_older_version_stays_readable(spark, frame):
    folder = scratch_path(spark, "codes")
    old = CodeBook().grown(frame("v string", ("b",), ("d",)), "v", folder)
    old.grown(frame("v string", ("a",), ("d",)), "v", folder)
    assert {(r.value, r.code) for r in old.table(spark).collect()} == {("b", 0), ("d", 1)}


@pytest.mark.parametrize("in_plan", [0, 1000])
def test_a_plan_grows_and_moves_with_its_codes(spark, frame, monkeypatch, in_plan):
    monkeypatch.setattr(fitting, "LEVELS_IN_PLAN", in_plan)
    frames = [frame("k long, v string", *((i * 100 + j, b) for j, b in enumerate(batch))) for i, batch in enumerate(BATCHES)]
    config = CleanerConfig(
        enforce_schema={"v": "category"}, impute_categorical=False, drop_constant_columns=False, drop_col_null_threshold=None,
        winsorize_lower_q=None, winsorize_upper_q=None, mark_outliers_zscore=False,
    )
    plan = fit(frames[0], config)
    for df in frames[1:]:
        plan = with_new_levels(plan, df)
    home, moved = scratch_path(spark, "plan"), scratch_path(spark, "elsewhere")
    save_plan(plan, spark, home)
    shutil.copytree(home, moved)
    again = load_plan(spark, moved)
    assert all(p.startswith(moved) for p in again.levels["v"]["parts"])
    for batch, df in zip(BATCHES, frames, strict=True):
        got = [r.v for r in again.transform(df).orderBy("k").collect()]
        assert got == [WANT.get(b) for b in batch]
    unknown = again.transform(frame("k long, v string", (1, "never"))).first()
    assert unknown.v == 7
