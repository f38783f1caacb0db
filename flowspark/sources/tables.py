"""Tables, fixed batches and file streams."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.stream import BATCH, Stream

#: Fixed value: the default number of rows in a batch made from a row source.
MAX_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed_batches(spark: SparkSession, schema: str, max_batch: int, rows: Sequence[tuple], cycles: int = 1) -> Stream:
    """``rows`` in batches of ``max_batch``, the whole ``cycles`` times."""
    fields = T.StructType.fromDDL(schema)
    per_cycle = math.ceil(len(rows) / max_batch)
    numbered = [(c * per_cycle + i // max_batch, *r) for c in range(cycles) for i, r in enumerate(rows)]
    return Stream(spark.createDataFrame(numbered, T.StructType([T.StructField(BATCH, T.LongType()), *fields.fields])), BATCH)


def fed_batches(spark: SparkSession, schema: str, batches: Sequence[Sequence[tuple]], partitions: int = 1) -> Stream:
    """Each inner list is a batch; its rows are dealt round-robin to ``partitions``, numbered in ``partition``."""
    fields = T.StructType.fromDDL(schema)
    numbered = [(b, i % partitions, *r) for b, batch in enumerate(batches) for i, r in enumerate(batch)]
    return Stream(spark.createDataFrame(numbered, T.StructType([T.StructField(BATCH, T.LongType()), T.StructField("partition", T.IntegerType()), *fields.fields])), BATCH)


def partitioned_batches(spark: SparkSession, schema: str, partitions: dict[int, Sequence[tuple]], take: int) -> Stream:
    """A replayable source: a batch takes the next ``take`` rows of every partition."""
    fields = T.StructType.fromDDL(schema)
    numbered = [(i // take, p, *r) for p, rows in partitions.items() for i, r in enumerate(rows)]
    return Stream(spark.createDataFrame(numbered, T.StructType([T.StructField(BATCH, T.LongType()), T.StructField("partition", T.IntegerType()), *fields.fields])), BATCH)


def in_batches(df: DataFrame, number: Column) -> Stream:
    """A static table as batches: ``number`` gives each row's batch."""
    return Stream(df.withColumn(BATCH, number.cast("long")), BATCH)


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_batch: int = 1, **options: str) -> DataFrame:
    """A folder, or one file, as a replayable stream: the offset log fixes which files make up which batch."""
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern that matches the path alone: a plain path must be a folder
    return spark.readStream.schema(schema).options(maxFilesPerTrigger=files_per_batch, **options).format(fmt).load(path)


def static_state(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A read-only lookup table from literals."""
    return spark.createDataFrame(list(rows), schema)


def orders_csv(spark: SparkSession, path: str, streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pipe-separated orders as (buys, sells): S sells, anything else buys."""
    schema = "order_no long, acct_id string, sec_code long, price double, volume long, date string, time string, ms string, direction string"
    reader = spark.readStream if streaming else spark.read
    df = reader.schema(schema).option("sep", "|").csv(path)
    df = df.withColumn("ts", F.to_timestamp(F.concat_ws(" ", "date", F.concat_ws(".", "time", "ms")), "yyyyMMdd HH:mm:ss.SSS"))
    return df.filter(~F.col("direction").eqNullSafe("S")), df.filter(F.col("direction") == "S")
