"""Checks that keyed state saw every row once and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def xor_check(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, xor, n): values that arrive in pairs cancel out; order and partitioning don't matter."""
    return df.groupBy(key).agg(F.bit_xor(value).alias("xor"), F.count(F.lit(1)).alias("n"))


def gaps(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The rows at which a key's sequence of values doesn't go up by one."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col(value) != F.col("before") + 1))
