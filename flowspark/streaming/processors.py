"""Stateful processors for ``transformWithState`` (needs the RocksDB state store)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class RunningCount(StatefulProcessor):
    """Each row with the number of rows of its key so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        for part in rows:
            yield pd.DataFrame({"key": [key[0]] * len(part), "running": range(n + 1, n + 1 + len(part))})
            n += len(part)
        self.count.update((n,))

    def close(self) -> None:
        pass


class LastSeen(StatefulProcessor):
    """A key's value, forgotten a given time after it was last set; emits whether the key was known."""

    ttl_ms = 30_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "v string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        known = self.value.exists()
        for part in rows:
            yield pd.DataFrame({"key": [key[0]] * len(part), "known": [known] + [True] * (len(part) - 1) if len(part) else []})
            known = True
            self.value.update((str(part.iloc[-1, -1]),))

    def close(self) -> None:
        pass


def running_count_stream(df: DataFrame, key: str) -> DataFrame:
    """(key, running) for a streaming ``df``; ``key`` is a string field."""
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=RunningCount(), outputStructType="key string, running long", outputMode="Append", timeMode="None")


def expiring_keys(df: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """(key, known) for a streaming ``df``: whether the key was seen within the last ``ttl_ms``."""
    processor = LastSeen()
    processor.ttl_ms = ttl_ms
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType="key string, known boolean", outputMode="Append", timeMode="ProcessingTime")
