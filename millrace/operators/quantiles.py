"""Exact quantiles of many columns without a sort and without a per-column value map.

``percentile`` keeps every distinct value of a column in one task.  Here the wanted order
statistics are narrowed down instead: a bounded, mergeable sketch proposes cut points, an exact
count of the rows below and at each cut tells in which gap each wanted rank lies, and the next
round looks only into that gap.  One round shrinks a gap to the sketch's rank error, and a
frequent value becomes a cut point itself, so it ends the search rather than filling a gap.  Once
a gap is counted to hold few rows, its values are sorted inside an aggregate of that known size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.longform import SLOT, as_double, melt
from millrace.operators.names import bare

GAP_ROWS = 200_000  # rows of one gap that may be sorted inside one aggregate
SKETCH_K = 2_000  # size of one sketch; its rank error is about 0.15 %
MARGIN = 0.004  # cut points are put this far to both sides of a wanted rank
PER_JOB = 300  # aggregates per job; each job reads only its own columns


@dataclass
class _Gap:
    """An open interval of one column that holds wanted ranks."""

    column: str
    ranks: list[int]
    before: int  # rows at or below ``low``
    size: int
    low: float | None = None
    high: float | None = None

    def inside(self, df: DataFrame) -> Column:
        """The value where it lies in the gap, else NULL."""
        x = as_double(df, self.column)
        tests = []
        if self.low is not None:
            tests.append(x > F.lit(self.low))
        if self.high is not None:
            tests.append(x < F.lit(self.high))
        for test in tests:
            x = F.when(test, x)
        return x

    def offsets(self) -> list[int]:
        return [r - self.before for r in self.ranks]

    def shares(self) -> list[float]:
        return [o / max(1, self.size - 1) for o in self.offsets()]


@dataclass
class _Stats:
    rows: int = 0
    at: dict[int, float] = field(default_factory=dict)  # rank → value


def _batches(items: Sequence, per: int) -> Iterable[Sequence]:
    for start in range(0, len(items), per):
        yield items[start : start + per]


def _around(shares: Iterable[float]) -> list[float]:
    """The given shares of a gap, a margin to both sides."""
    both = {s + d for s in shares for d in (-MARGIN, MARGIN)}
    return sorted({min(1.0, max(0.0, s)) for s in both})


def _sketches(
    df: DataFrame, gaps: Sequence[tuple[_Gap, list[float]]], k: int
) -> list[tuple[int, list[float]]]:
    """Per gap: exact row count, and cut points proposed around the wanted shares."""
    out = []
    for batch in _batches(gaps, PER_JOB // 2):
        aggs = []
        for i, (gap, _) in enumerate(batch):
            x = gap.inside(df)
            aggs += [
                F.count(x).alias(f"n{i}"),
                F.kll_sketch_agg_double(x, k).alias(f"s{i}"),
            ]
        sketched = df.agg(*aggs)
        row = sketched.select(
            *(F.col(f"n{i}") for i in range(len(batch))),
            *(
                F.when(
                    F.col(f"n{i}") > 0,
                    F.kll_sketch_get_quantile_double(
                        f"s{i}", F.array(*(F.lit(p) for p in _around(shares)))
                    ),
                ).alias(f"q{i}")
                for i, (_, shares) in enumerate(batch)
            ),
        ).first()
        out += [(row[f"n{i}"], sorted(set(row[f"q{i}"] or []))) for i in range(len(batch))]
    return out


def _split(df: DataFrame, gaps: Sequence[_Gap], cuts: Sequence[list[float]], stats) -> list[_Gap]:
    """Count rows below and at every cut, settle ranks that hit a cut, return the smaller gaps."""
    flat = [(g, c) for g, cs in enumerate(cuts) for c in cs]
    counted: dict[tuple[int, float], tuple[int, int]] = {}
    for batch in _batches(flat, PER_JOB // 2):
        aggs = []
        for j, (g, c) in enumerate(batch):
            x = bare(gaps[g].column).cast("double")
            aggs += [
                F.sum((x < F.lit(c)).cast("long")).alias(f"b{j}"),
                F.sum((x <= F.lit(c)).cast("long")).alias(f"u{j}"),
            ]
        row = df.agg(*aggs).first()
        for j, key in enumerate(batch):
            counted[key] = (row[f"b{j}"], row[f"u{j}"])

    smaller = []
    for g, gap in enumerate(gaps):
        edges = [(gap.low, gap.before, gap.before)]
        edges += [(c, *counted[g, c]) for c in cuts[g]]
        end = gap.before + gap.size
        edges.append((gap.high, end, end))
        for (low, _, upto), (high, below, _) in zip(edges, edges[1:]):
            ranks = [r for r in gap.ranks if upto <= r < below]
            if ranks:
                smaller.append(_Gap(gap.column, ranks, upto, below - upto, low, high))
        for c, below, upto in edges[1:-1]:
            for r in gap.ranks:
                if below <= r < upto:
                    stats[gap.column].at[r] = c
    return smaller


def _pick(df: DataFrame, gaps: Sequence[_Gap], stats) -> None:
    """Read the wanted ranks off the sorted values of gaps known to be small."""
    if not gaps:
        return
    offsets = F.array(*(F.array(*(F.lit(o) for o in g.offsets())) for g in gaps))
    picked = (
        melt(df, [{"x": g.inside(df)} for g in gaps])
        .where(F.col("x").isNotNull())
        .groupBy(SLOT)
        .agg(F.sort_array(F.collect_list("x")).alias("xs"))
        .select(
            SLOT, F.transform(F.get(offsets, F.col(SLOT)), lambda o: F.get("xs", o)).alias("found")
        )
    )
    for slot, found in picked.collect():
        gap = gaps[slot]
        stats[gap.column].at.update(zip(gap.ranks, found))


def _ranks(rows: int, probs: Sequence[float]) -> list[int]:
    return sorted({f(p * (rows - 1)) for p in probs for f in (math.floor, math.ceil)})


def _sort_whole(df: DataFrame, columns: Sequence[str], probs: Sequence[float], stats) -> None:
    """Tables known to be small need one pass: sort each column inside the aggregate."""
    n = F.size("xs")
    place = [F.lit(p) * (n - 1) for p in probs]
    at = F.array(*(f(p).cast("int") for p in place for f in (F.floor, F.ceil)))
    found = (
        melt(df, [{"x": as_double(df, c)} for c in columns])
        .where(F.col("x").isNotNull())
        .groupBy(SLOT)
        .agg(F.sort_array(F.collect_list("x")).alias("xs"))
        .withColumn("ranks", at)
        .select(SLOT, n.alias("n"), "ranks", F.transform("ranks", lambda r: F.get("xs", r)))
    )
    for slot, rows, ranks, values in found.collect():
        stats[columns[slot]] = _Stats(rows, dict(zip(ranks, values)))


def order_statistics(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    gap_rows: int = GAP_ROWS,
    sketch_k: int = SKETCH_K,
    rows_at_most: int | None = None,
) -> dict[str, _Stats]:
    """Per column: the number of non-null values and the values at the ranks ``probs`` need.

    ``rows_at_most`` is the table's row count where the caller has it from an earlier pass.
    """
    stats = {c: _Stats() for c in columns}
    if not columns:
        return stats
    slim = df.select(*(bare(c) for c in columns))
    if rows_at_most is not None and rows_at_most <= gap_rows:
        for batch in _batches(columns, PER_JOB):
            _sort_whole(slim, batch, probs, stats)
        return stats
    whole = [(_Gap(c, [], 0, 0), list(probs)) for c in columns]
    first = _sketches(slim, whole, sketch_k)
    small, large, cuts = [], [], []
    for c, (rows, proposed) in zip(columns, first):
        stats[c].rows = rows
        if not rows:
            continue
        gap = _Gap(c, _ranks(rows, probs), 0, rows)
        if rows <= gap_rows:
            small.append(gap)
        else:
            large.append(gap)
            cuts.append(proposed)
    while large:
        gaps = _split(slim, large, cuts, stats)
        small += [g for g in gaps if g.size <= gap_rows]
        large = [g for g in gaps if g.size > gap_rows]
        cuts = [q for _, q in _sketches(slim, [(g, g.shares()) for g in large], sketch_k)]
    for batch in _batches(small, PER_JOB):
        _pick(slim, batch, stats)
    return stats


def interpolate(stats: _Stats, prob: float) -> float | None:
    """The quantile by linear interpolation between two neighbouring order statistics."""
    if not stats.rows:
        return None
    place = prob * (stats.rows - 1)
    low, high = stats.at[math.floor(place)], stats.at[math.ceil(place)]
    return low if low == high else low + (high - low) * (place - math.floor(place))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], **options
) -> dict[str, list[float | None]]:
    """``{column: [quantile per prob]}``, exact, with linear interpolation."""
    stats = order_statistics(df, columns, probs, **options)
    return {c: [interpolate(stats[c], p) for p in probs] for c in columns}


def approx_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 10_000
) -> dict[str, list[float | None]]:
    """One pass, one mergeable sketch per column; the rank error is at most rows / accuracy."""
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    if not columns:
        return out
    sketched = (
        melt(df, [{"x": as_double(df, c)} for c in columns])
        .groupBy(SLOT)
        .agg(F.percentile_approx("x", list(probs), accuracy).alias("q"))
    )
    for slot, q in sketched.collect():
        if q is not None:
            out[columns[slot]] = list(q)
    return out
