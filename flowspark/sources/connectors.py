"""External systems. Formats that need a jar fail with Spark's own message where it is missing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.state import StateTable
from flowspark.state.query import map_get


def kafka_stream(spark: SparkSession, servers: str, topic: str, start: str = "latest", max_offsets: int | None = None, **options: str) -> DataFrame:
    """(key, value, topic, partition, offset, timestamp); also for services that speak the same protocol."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start} | options
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return spark.readStream.format("kafka").options(**options).load()


def kafka_sink(df: DataFrame, servers: str, topic: str, key: str, value: str, checkpoint: str):
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    return rows.writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint})


def delimited_sink(df: DataFrame, path: str, sep: str = ",", max_rows: int | None = None, partition_by: Sequence[str] = ()) -> None:
    """Delimited files, rotated after ``max_rows`` rows, in folders by ``partition_by``."""
    writer = df.write.mode("append").option("sep", sep)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def jdbc_sink(url: str, table: str, batch: int = 1000, **properties: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``."""
    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("append").option("batchsize", batch).jdbc(url, table, properties=properties)
    return write


def jdbc_lookup(spark: SparkSession, url: str, query: str, **properties: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **properties).load()


def table_sink(table: str, partition_by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Append to a catalogue table, for ``foreachBatch``."""
    def write(df: DataFrame, epoch: int) -> None:
        writer = df.write.mode("append")
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
    return write


def store_sink(state: StateTable) -> Callable[[DataFrame, int], None]:
    """Put the rows of each batch into a key-value state, for ``foreachBatch``."""
    def write(df: DataFrame, epoch: int) -> None:
        state.put(df, epoch)
    return write


def store_lookup(rows: DataFrame, state: StateTable, on: Sequence[tuple[str, str]], out: str) -> DataFrame:
    return map_get(rows, state.snapshot(), on, state.value, out)


def index_sink(send: Callable[[list[dict]], None], batch: int = 500) -> Callable[[DataFrame, int], None]:
    """Hand rows to ``send`` in lists, on the executors: for search indexes and other services with a client."""
    def partition(rows) -> None:
        held: list[dict] = []
        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) >= batch:
                send(held)
                held = []
        if held:
            send(held)

    def write(df: DataFrame, epoch: int) -> None:
        df.foreachPartition(partition)
    return write
