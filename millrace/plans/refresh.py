"""Refresh a fitted plan from the state of all batches so far, without reading old rows."""

from __future__ import annotations

from copy import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import state
from millrace.operators.longform import number_columns, text_columns
from millrace.operators.moments import Moments
from millrace.plans.cleaning import CleaningPlan

GRID = 400  # points at which the distribution of limited values is read


def keep_batch(plan: CleaningPlan, df: DataFrame, path: str, batch: str) -> None:
    """Add a batch to the plan's state: its rows as they are before numbers are limited and gaps filled."""
    stage = plan.transform(df, until="limit_numeric")
    state.add_batch(stage, path, batch, number_columns(stage) + text_columns(stage))


def refreshed(plan: CleaningPlan, spark: SparkSession, path: str) -> CleaningPlan:
    """``plan`` with the limits, medians, moments and fills of all kept batches.

    Limits and medians are quantiles within ``state.KLL_ERROR`` of the rows.  Moments are exact where nothing is
    limited, else those of the limited distribution read at ``GRID`` points.  What the plan fitted besides, such as
    columns, readings and codes, stays.
    """
    cfg, out = plan.config, copy(plan)
    low, high = cfg.winsorize_lower_q, cfg.winsorize_upper_q
    points = [(i + 0.5) / GRID for i in range(GRID)]
    shares = [low or 0.0, 0.5, 1.0 if high is None else high]
    stats, values = state.load(spark, path)
    rows = state.merged_stats(stats).where("n > 0").select(
        "column_name", "n", "n_null", "n_rows", "mean", "m2", state.quantiles(shares).alias("cuts"), state.quantiles(points).alias("grid")
    )
    out.bounds, out.medians, out.moments, out.fills = dict(plan.bounds), dict(plan.medians), dict(plan.moments), dict(plan.fills)
    for r in rows.collect():  # one row per column
        c = r.column_name
        if c in plan.bounds:
            out.bounds[c] = (r.cuts[0], r.cuts[2])
        if cfg.impute_numeric and r.n_null:
            out.medians[c] = out.limit_value(c, r.cuts[1])
        if c in plan.moments:
            mean, var = r.mean, r.m2 / r.n
            if c in out.bounds:
                grid = [out.limit_value(c, v) for v in r.grid]
                mean = sum(grid) / GRID
                var = sum((v - mean) ** 2 for v in grid) / GRID
            found = Moments(r.n_rows, r.n, mean, var)
            found = found.filled(out.medians[c]) if c in out.medians else found
            out.moments[c] = (found.mean, found.sd)
        out.rows_filled = max(out.rows_filled, r.n_rows)
    if cfg.impute_categorical and cfg.categorical_strategy == "mode":
        best = state.merged_values(stats, values).groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b"))
        texts = {r[0]: r[1] for r in best.select("column_name", "b.value").collect()}
        out.fills |= {c: texts[c] for c in plan.fills if c in texts}
    return out

