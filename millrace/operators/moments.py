"""Means and deviations, also of columns whose gaps will be filled with one value."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.longform import SLOT, melt


@dataclass(frozen=True)
class Moments:
    rows: int
    n: int  # rows with a value
    mean: float
    var: float  # population variance

    @property
    def gaps(self) -> int:
        return self.rows - self.n

    @property
    def sd(self) -> float:
        return math.sqrt(self.var)

    def filled(self, value: float) -> Moments:
        """The same after every gap got ``value``: needs no further pass over the data."""
        if not self.gaps or not self.rows:
            return self
        mean = (self.n * self.mean + self.gaps * value) / self.rows
        spread = self.n * (self.var + (self.mean - mean) ** 2) + self.gaps * (value - mean) ** 2
        return Moments(self.rows, self.rows, mean, spread / self.rows)


def moments(df: DataFrame, values: Sequence[Column], names: Sequence[str]) -> Mapping[str, Moments]:
    """Per column, in one pass."""
    if not names:
        return {}
    rows = (
        melt(df, [{"x": v} for v in values])
        .groupBy(SLOT)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("x").alias("n"),
            F.coalesce(F.avg("x"), F.lit(0.0)).alias("mean"),
            F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("var"),
        )
        .collect()
    )
    found = {r[SLOT]: Moments(r["rows"], r["n"], r["mean"], r["var"]) for r in rows}
    return {c: found.get(i, Moments(0, 0, 0.0, 0.0)) for i, c in enumerate(names)}
