"""Plans whose category codes grow, and plans that are kept in a folder together with their code tables."""

from __future__ import annotations

import json
import uuid
from copy import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.codes import CodeBook
from millrace.operators.names import bare
from millrace.plans.cleaning import CleaningPlan, read_levels
from millrace.session import scratch_path


def _book(spark: SparkSession, fitted: dict, folder: str) -> CodeBook:
    if "values" not in fitted:
        return CodeBook(tuple(fitted.get("parts") or [fitted["path"]]), fitted["rows"], fitted["bytes"])
    table, rows, size = read_levels(spark, fitted)
    if not rows:
        return CodeBook()
    path = f"{folder}/codes-fitted"
    table.select(F.col("value").cast("string").alias("value"), "code").write.parquet(path)
    return CodeBook((path,), rows, size)


def with_new_levels(plan: CleaningPlan, df: DataFrame, folder: str | None = None) -> CleaningPlan:
    """``plan`` with codes for the levels that only ``df`` has, behind those it has; none is changed.

    New parts are written below ``folder``, by default in scratch space; ``save_plan`` takes them along.
    """
    out, spark = copy(plan), df.sparkSession
    out.levels = dict(plan.levels)
    stage = plan.transform(df, until="enforce_schema", skip=("dedupe_rows",))
    for c, fitted in plan.levels.items():
        if c in stage.columns:
            place = f"{folder.rstrip('/')}/{uuid.uuid4().hex}" if folder else scratch_path(spark, "levels")
            book = _book(spark, fitted, place).grown(stage.select(bare(c).cast("string").alias(c)), c, place)
            out.levels[c] = {"parts": list(book.parts), "rows": book.rows, "bytes": book.size}
    return out


def save_plan(plan: CleaningPlan, spark: SparkSession, folder: str) -> None:
    """Write a plan and all its code tables into a new folder, which can be copied or moved as a whole."""
    out = copy(plan)
    out.levels = {}
    for i, (c, fitted) in enumerate(plan.levels.items()):
        if "values" in fitted:
            out.levels[c] = fitted
            continue
        table, rows, size = read_levels(spark, fitted)
        table.write.parquet(f"{folder}/levels-{i}")
        out.levels[c] = {"parts": [f"levels-{i}"], "rows": rows, "bytes": size}
    spark.createDataFrame([(out.to_json(),)], "plan string").coalesce(1).write.text(f"{folder}/plan")


def load_plan(spark: SparkSession, folder: str) -> CleaningPlan:
    data = json.loads(spark.read.text(f"{folder}/plan", wholetext=True).first()[0])
    for fitted in data["levels"].values():
        if "parts" in fitted:
            fitted["parts"] = [f"{folder}/{p}" for p in fitted["parts"]]
    return CleaningPlan.from_json(json.dumps(data))
