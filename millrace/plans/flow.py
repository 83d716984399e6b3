"""From a file to a stored, analysed and queryable table."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.profile import analyze
from millrace.operators.sqlq import SqlAgent
from millrace.plans.cleaning import CleaningPlan
from millrace.plans.config import CleanerConfig
from millrace.plans.fit import fit
from millrace.session import spread_once
from millrace.sources.readers import read_any
from millrace.sources.sinks import save_table, write_csv


@dataclass
class Outcome:
    status: str
    table: str | None = None
    cleaned: DataFrame | None = None
    report: DataFrame | None = None
    analysis: dict[str, DataFrame] = field(default_factory=dict)
    plan: CleaningPlan | None = None
    answer: DataFrame | None = None
    sql: str | None = None
    explanation: str | None = None
    error: str | None = None


def table_name(path: str) -> str:
    """A table name from a file name."""
    stem = PurePosixPath(path.rstrip("/")).name.split(".")[0]
    return re.sub(r"\W+", "_", stem).lower() or "data"


def run_pipeline(
    spark: SparkSession,
    path: str,
    table: str | None = None,
    fmt: str | None = None,
    config: CleanerConfig | None = None,
    table_path: str | None = None,
    csv_path: str | None = None,
    **read_options,
) -> Outcome:
    """Read → fit → transform → store → analyse.  Errors are raised.

    The cleaned rows are computed once, while they are stored; the analysis reads the stored
    columnar table.  Rows are counted on the way, so the report needs no further job.
    """
    raw = spread_once(read_any(spark, path, fmt, **read_options))
    plan = fit(raw, config)
    if not plan.rows_filled:
        raise ValueError("no rows were read")
    seen = Observation()
    trace: list[dict] = []
    cleaned = plan.transform(raw, trace=trace).observe(seen, F.count(F.lit(1)).alias("rows"))
    name = save_table(cleaned, table or table_name(path), table_path, known_filled=True)
    stored = spark.table(name)
    if csv_path:
        write_csv(stored, csv_path)
    return Outcome(
        "success",
        table=name,
        cleaned=stored,
        report=plan.report(spark, trace, rows_out=seen.get["rows"]),
        analysis=analyze(stored, approx=plan.config.approx),
        plan=plan,
    )


def run_workflow(
    spark: SparkSession,
    path: str,
    question: str | None = None,
    translate: Callable[[str], str] | None = None,
    method: str = "query",
    **options,
) -> Outcome:
    """The pipeline and, if asked, a question to its table.  Failures are returned, not raised."""
    try:
        out = run_pipeline(spark, path, **options)
        if question:
            if translate is None:
                raise ValueError("a question needs a translate function")
            reply = SqlAgent(spark, translate, [out.table]).by_method(method, question)
            if not reply.ok:
                raise RuntimeError(reply.explanation)
            out.answer, out.sql, out.explanation = reply.result, reply.sql, reply.explanation
        return out
    except Exception as error:  # noqa: BLE001 - the outcome carries any failure
        return Outcome("error", error=str(error))
