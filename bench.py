"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace.plans.fit import fit  # noqa: E402
from millrace.session import local_session  # noqa: E402
from queries import all_queries  # noqa: E402
from queries.base import dirty_orders  # noqa: E402

NAMES = (
    "clean_table",
    "profile_columns",
    "describe",
    "correlation",
    "top_values",
    "winsorize_numeric",
    "duplicate_count",
    "dedupe_rows",
    "dictionary_encode",
    "json_expand",
    "html_text",
    "sql_agg",
    "sql_join",
    "sql_window_rank",
    "ml_preprocess",
    "ml_predict",
    "stream_clean",
    "file_to_table",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run, repeats: int) -> float:
    run()  # warm-up
    seconds = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "millrace-bench")
    spark.sparkContext.setLogLevel("OFF")
    queries, out = all_queries(), {}
    for name in NAMES:
        run = queries[name]
        out[name] = timed(lambda run=run: drain(run(spark, folder)), repeats)
        print(name, out[name], file=sys.stderr, flush=True)
    dirty = dirty_orders(spark, folder)
    plan = fit(dirty)
    out["clean_table_transform_only"] = timed(lambda: drain(plan.transform(dirty)), repeats)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": out,
        "sf": Path(folder).name.removeprefix("sf"),
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark": spark.version,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
