"""Metrics of streams: observed counters, and progress by listener."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counters(df: DataFrame, name: str, by: dict[str, Column]) -> DataFrame:
    """Count, in passing, the rows for which each condition holds."""
    return df.observe(name, *[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(k) for k, c in by.items()])


def mean(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.observe(name, F.avg(value).alias("mean"), F.count(value).alias("n"))


class Progress(StreamingQueryListener):
    """Keeps, for each query, rows and observed metrics of every batch. ``read`` gives and resets them."""

    def __init__(self):
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({"query": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond,
                             "observed": {k: v.asDict() for k, v in p.observedMetrics.items()}})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def read(self) -> list[dict]:
        out, self.batches = self.batches, []
        return out
