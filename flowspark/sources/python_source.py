"""A source written in Python: rows by offset, replayed exactly after a failure."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class CounterSource(DataSource):
    """Numbers 0, 1, 2 ... with key = number modulo ``keys``. Options: ``rows`` (all in all), ``perBatch``, ``keys``."""

    @classmethod
    def name(cls) -> str:
        return "counter"

    def schema(self) -> str:
        return "number long, key long"

    def reader(self, schema) -> DataSourceReader:
        return CounterReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return CounterStreamReader(self.options)


class CounterReader(DataSourceReader):
    def __init__(self, options):
        self.rows, self.keys = int(options.get("rows", 100)), int(options.get("keys", 10))

    def partitions(self):
        step = max(1, self.rows // 4)
        return [InputPartition((a, min(a + step, self.rows))) for a in range(0, self.rows, step)]

    def read(self, partition):
        for i in range(*partition.value):
            yield i, i % self.keys


class CounterStreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.rows, self.per_batch, self.keys = int(options.get("rows", 100)), int(options.get("perBatch", 10)), int(options.get("keys", 10))

    def initialOffset(self) -> dict:
        return {"next": 0}

    def read(self, start: dict):
        end = min(start["next"] + self.per_batch, self.rows)
        return self.readBetweenOffsets(start, {"next": end}), {"next": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(i, i % self.keys) for i in range(start["next"], end["next"])])
