"""Registered queries and their SQL counterparts, by topic."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # before the topics' helpers are used

from queries import cleaning, files, models, profiling, sqlsurface  # noqa: E402

TOPICS = (cleaning, profiling, sqlsurface, models, files)


def all_queries() -> dict:
    return {name: run for topic in TOPICS for name, run in topic.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for topic in TOPICS for name, sql in topic.ORACLES.items()}
