"""Rows that come after the watermark: Spark drops them; here they are counted, batch by batch, in a table."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

LATE_ROWS = "query string, run string, batch long, operator int, dropped long, at timestamp"


class _Count(StreamingQueryListener):
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.begun, self.ended, self.idle, self.failure = set(), set(), threading.Event(), None

    def onQueryStarted(self, event) -> None:
        self.idle.clear()
        self.begun.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(p.name or str(p.id), str(p.runId), p.batchId, k, o.numRowsDroppedByWatermark, datetime.now(UTC)) for k, o in enumerate(p.stateOperators) if o.numRowsDroppedByWatermark]
        if rows:
            try:
                self.spark.createDataFrame(rows, LATE_ROWS).coalesce(1).write.mode("append").parquet(self.folder)
            except Exception as e:  # told to the caller when the block ends: an exception here would only reach a log
                self.failure = e

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))
        if self.ended >= self.begun:
            self.idle.set()


@contextmanager
def counting_late_rows(spark: SparkSession, folder: str, wait: float = 60) -> Iterator[None]:
    """Queries that run within the block leave, in `folder`, a row for each batch and stateful operator that dropped late rows (see LATE_ROWS).

    An aggregation is handed rows that are added up within their partition already, so its count is of those; deduplication, joins and
    transformWithState count the rows themselves. A batch that is run again is reported again: take the greatest `dropped` of (query, batch, operator).
    The block ends when the listener has heard that its queries ended, so all counts are there then.
    """
    listener = _Count(spark, folder)
    spark.streams.addListener(listener)
    try:
        yield
        if listener.begun and not listener.idle.wait(wait):
            raise TimeoutError("the listener has not heard of the end of all queries")
        if listener.failure:
            raise listener.failure
    finally:
        spark.streams.removeListener(listener)


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(query, batch, operator, dropped) of the folder, each batch once."""
    got = spark.read.schema(LATE_ROWS).parquet(folder)
    return got.groupBy("query", "batch", "operator").agg({"dropped": "max"}).withColumnRenamed("max(dropped)", "dropped")
