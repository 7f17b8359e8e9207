"""Registered queries of the gridded-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberframe.plans import joins, measures, rasters, rows, stores, streams
from emberframe.plans.views import rounded, sql

MODULES = (rows, stores, measures, joins, rasters, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for module in MODULES:
        for name, (run, _) in module.QUERIES.items():
            out[name] = lambda spark, sf_dir, run=run: rounded(run(spark, sf_dir))
    return out


def oracle_sql() -> dict[str, str]:
    return {name: sql(text) for module in MODULES for name, (_, text) in module.QUERIES.items() if text}
