"""Fitting: a handful of aggregation passes turn a table into a cleaning plan.

Passes over the data, whatever the number of columns:

1. one fused look at all columns (null shares, constancy, all text patterns);
2. only if JSON columns were found: their fields, one pass per nesting level;
3. only if new text columns came into being: their delimiters and digits;
4. order statistics of the numeric columns (a sketch, a count, a small pick); on large tables those
   that come from text are written once before, so that no pass reads the text again;
5. mean and deviation of the limited values, when outliers are marked;
6. only for ``categorical_strategy="mode"`` or category columns: value counts.

Every pass returns a few numbers per column; nothing that grows with the rows reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import frequency, lookup, names
from millrace.operators.longform import nan_to_null, number_columns, text_columns
from millrace.operators.moments import moments
from millrace.operators.names import bare
from millrace.operators.quantiles import GAP_ROWS, approx_quantiles, interpolate, order_statistics
from millrace.plans import look as looks
from millrace.plans.cleaning import NO_CATEGORY_TYPE, CleaningPlan, Step
from millrace.plans.config import CleanerConfig
from millrace.plans.json_fields import find_fields
from millrace.session import scratch_path

LEVELS_IN_PLAN = 1_000  # larger level tables are written next to the checkpoints; plans.growth.save_plan takes them along
NUMBERS_ROWS = GAP_ROWS  # more rows take several passes over the numbers: those that come from text are then written once


def fit(
    df: DataFrame,
    config: CleanerConfig | None = None,
    steps: Sequence[tuple[str, Step]] = (),
) -> CleaningPlan:
    """Learn a cleaning plan.  ``steps`` are the user's own, run after the built-in ones."""
    cfg = config or CleanerConfig()
    cfg.check()
    plan = CleaningPlan(
        config=cfg,
        source=[(f.name, f.dataType.simpleString()) for f in df.schema.fields],
        steps=list(steps),
    )
    plan.skipped["set_category_dtype"] = NO_CATEGORY_TYPE
    found = _fit_columns(plan, df)
    stage = _fit_new_columns(plan, df, found)
    _fit_numbers(plan, stage)
    _fit_text(plan, stage)
    _fit_levels(plan, df)
    return plan


def clean(
    df: DataFrame,
    config: CleanerConfig | None = None,
    steps: Sequence[tuple[str, Step]] = (),
) -> tuple[DataFrame, DataFrame]:
    """``(cleaned, report)``: fit, then transform the same table."""
    plan = fit(df, config, steps)
    _try_user_steps(plan, df)
    trace: list[dict] = []
    cleaned = plan.transform(df, trace=trace)
    return cleaned, plan.report(df.sparkSession, trace)


def _try_user_steps(plan: CleaningPlan, df: DataFrame) -> None:
    """A user step that cannot be planned is skipped and reported, as a failing step always was."""
    if not plan.steps:
        return
    out = plan.transform(df, until=plan.steps[0][0])
    for name, step in plan.steps:
        try:
            done = step(out, plan)
            done.columns  # noqa: B018 - forces analysis
            out = done
        except Exception as error:  # noqa: BLE001 - any failure of foreign code
            plan.skipped[name] = str(error).splitlines()[0]


def _fit_columns(plan: CleaningPlan, df: DataFrame) -> dict[str, looks.Look]:
    cfg = plan.config
    tidy = nan_to_null(df.toDF(*names.tidy_names(df.columns)))
    plan.rows_in, found = looks.look_at_table(tidy, cfg)
    plan.rows_filled = next((k.rows for k in found.values()), 0)

    if not cfg.drop_constant_columns:
        plan.skipped["drop_constant_columns"] = "switched off"
    elif plan.rows_filled <= 1:
        plan.skipped["drop_constant_columns"] = "fewer than two rows: every column is constant"
    else:
        plan.constant = _constant(tidy, found)
    if cfg.drop_col_null_threshold is None:
        plan.skipped["drop_high_null_columns"] = "switched off"
    elif plan.rows_filled:
        plan.sparse = [
            c
            for c, k in found.items()
            if c not in plan.constant and k.null_share() >= cfg.drop_col_null_threshold
        ]
    gone = {*plan.constant, *plan.sparse}
    plan.kept = [c for c in tidy.columns if c not in gone]

    for c in text_columns(tidy):
        if c in gone:
            continue
        reading = looks.choose_reading(cfg, found[c])
        if reading:
            plan.readings[c] = reading
            continue
        if looks.is_json(cfg, found[c]):
            plan.json_columns.append(c)
    return found


def _constant(df: DataFrame, found: dict[str, looks.Look]) -> list[str]:
    """Columns with at most one distinct value, NULL counted as a value."""
    out = [c for c, k in found.items() if not k.present]
    same = [c for c, k in found.items() if k.same_hash and k.present == k.rows]
    if same:  # equal hashes only suggest it; one pass over these few columns proves it
        proof = df.agg(
            *(
                (F.min(looks.comparable(df, c)).eqNullSafe(F.max(looks.comparable(df, c)))).alias(
                    f"c{i}"
                )
                for i, c in enumerate(same)
            )
        ).first()
        out += [c for i, c in enumerate(same) if proof[f"c{i}"]]
    return [c for c in found if c in out]


def _fit_new_columns(
    plan: CleaningPlan, df: DataFrame, found: dict[str, looks.Look]
) -> DataFrame:
    """JSON fields, compound parts and number companions, in step order.

    Returns the frame before the numeric steps, rows without any value included.
    """
    cfg = plan.config
    changed = {c for c in cfg.categorical_synonyms if c in plan.kept}
    # Rows without any value hold nothing to learn from; not asking for them keeps every later pass
    # from reading all columns.  Their number is known from the first one.
    stage = plan.transform(df, until="json_column_expansion", skip=("drop_empty_rows",))
    for c in plan.json_columns:
        if c not in stage.columns:
            continue
        try:
            leaves = find_fields(stage, c, cfg.json_max_expand_cols)
        except Exception as error:  # noqa: BLE001 - one bad column must not end the whole fit
            plan.skipped_columns[c] = f"json_column_expansion: {str(error).splitlines()[0]}"
            leaves = None
        if leaves:
            taken = [n for n in stage.columns if n != c]
            for leaf, name in zip(leaves, names.unique_names((x["name"] for x in leaves), taken)):
                leaf["name"] = name
            plan.json_fields[c] = leaves
            others = [*taken, *(x["name"] for x in leaves)]
            plan.json_rest[c] = names.unique_names([f"{c}__rest"], others)[0]

    stage = plan.transform(stage, "json_column_expansion", "split_compound_columns")
    rests = {*plan.json_rest.values()}
    texts = [c for c in text_columns(stage) if c not in rests]
    fresh = [c for c in texts if c not in found or c in changed]
    found = found | looks.look_at_shapes(stage, fresh, cfg, plan.rows_filled)
    for c in texts:
        parts = looks.part_count(cfg, found[c])
        taken = {n.lower() for n in stage.columns}
        if parts and not {f"{c}_part{i + 1}".lower() for i in range(parts)} & taken:
            plan.parts[c] = parts

    stage = plan.transform(stage, "split_compound_columns", "extract_numbers_from_text")
    texts = [c for c in text_columns(stage) if c not in rests]
    found = found | looks.look_at_shapes(
        stage, [c for c in texts if c not in found], cfg, plan.rows_filled
    )
    plan.numbers = [
        c
        for c in texts
        if looks.holds_numbers(cfg, found[c])
        and f"{c}_num".lower() not in {n.lower() for n in stage.columns}
    ]
    return plan.transform(stage, "extract_numbers_from_text", "limit_numeric")


def _fit_numbers(plan: CleaningPlan, stage: DataFrame) -> None:
    cfg = plan.config
    columns = number_columns(stage)
    if not columns or not plan.rows_filled:
        return
    low, high = cfg.winsorize_lower_q, cfg.winsorize_upper_q
    limited = [
        c
        for c in columns
        if None not in (low, high)
        and not (cfg.winsorize_exclude_ids and names.is_id_like(c, cfg.id_keywords))
    ]
    shares = [p for p in (low, 0.5, high) if p is not None]
    if cfg.approx:
        sketched = approx_quantiles(stage, columns, shares)
        for c in limited:
            if sketched[c][0] is not None:
                plan.bounds[c] = (sketched[c][0], sketched[c][-1])
        middle = {c: [q[shares.index(0.5)]] for c, q in sketched.items() if q[0] is not None}
        counts = None
    else:
        if plan.rows_filled > NUMBERS_ROWS and (plan.readings or plan.json_fields or plan.numbers):
            stage = _stored_numbers(stage, columns)
        stats = order_statistics(stage, columns, shares, rows_at_most=plan.rows_filled)
        for c in limited:
            if stats[c].rows:
                plan.bounds[c] = (interpolate(stats[c], low), interpolate(stats[c], high))
        # Limiting keeps the order, so the median of the limited values follows from the same
        # order statistics and needs no further pass.
        middle = {
            c: [s.at[f(0.5 * (s.rows - 1))] for f in (math.floor, math.ceil)]
            for c, s in stats.items()
            if s.rows
        }
        counts = {c: s.rows for c, s in stats.items()}
    if cfg.impute_numeric:
        for c, values in middle.items():
            if counts is None or counts[c] < plan.rows_filled:
                limits = [plan.limit_value(c, v) for v in values]
                plan.medians[c] = sum(limits) / len(limits)
    if cfg.mark_outliers_zscore:
        _fit_moments(plan, stage, columns)


def _stored_numbers(stage: DataFrame, columns: list[str]) -> DataFrame:
    """The numeric columns alone, read from text once and written, not read from it again in each of the next passes."""
    slim = stage.select(*(bare(c).alias(f"c{i}") for i, c in enumerate(columns)))
    path = scratch_path(stage.sparkSession, "numbers")
    slim.write.parquet(path)
    return stage.sparkSession.read.schema(slim.schema).parquet(path).toDF(*columns)


def _fit_moments(plan: CleaningPlan, stage: DataFrame, columns: list[str]) -> None:
    """Mean and population deviation after imputation; the imputed rows enter in closed form."""
    found = moments(stage, [plan.limited(stage, c).cast("double") for c in columns], columns)
    for c, m in found.items():
        if m.n:
            m = replace(m, rows=plan.rows_filled)
            m = m.filled(plan.medians[c]) if c in plan.medians else m
            plan.moments[c] = (m.mean, m.sd)


def _fit_text(plan: CleaningPlan, stage: DataFrame) -> None:
    """Fills for text columns, which the numeric steps leave alone."""
    cfg = plan.config
    if not cfg.impute_categorical or not plan.rows_filled:
        return
    rests = {*plan.json_rest.values()}
    columns = [c for c in text_columns(stage) if c not in rests]
    if cfg.categorical_strategy == "mode":
        plan.fills = frequency.modes(stage, columns)
    else:
        plan.fills = dict.fromkeys(columns, cfg.categorical_impute_value)


def _fit_levels(plan: CleaningPlan, df: DataFrame) -> None:
    """Codes of the columns declared as categories, so that later batches get the same ones."""
    wanted = [c for c, kind in plan.config.enforce_schema.items() if kind == "category"]
    if not wanted:
        return
    stage = plan.transform(df, until="enforce_schema", skip=("dedupe_rows",))
    for c in wanted:
        if c not in stage.columns:
            continue
        as_text = stage.select(bare(c).cast("string").alias(c))
        table, rows, size = lookup.level_table(as_text, c)
        if rows <= LEVELS_IN_PLAN and size <= 1_000_000:
            values = [r[0] for r in table.orderBy("code").select("value").collect()]
            plan.levels[c] = {"values": values, "bytes": size}
        else:
            path = scratch_path(stage.sparkSession, "levels")
            table.write.parquet(path)
            plan.levels[c] = {"path": path, "rows": rows, "bytes": size}
