"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["filters", "joins", "aggregates", "windows", "sets", "topk", "graph", "scoring", "detectors", "anomalies", "coordination", "alerts", "functions", "quality", "telemetry", "sources", "streams"]


def _every() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for name in MODULES:
        for key, entry in importlib.import_module(f"transfergraph.catalog.{name}").QUERIES.items():
            if key in out:
                raise ValueError(f"{key} is registered twice")
            out[key] = entry
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _every().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _every().items() if sql}
