"""Workload generators, as expressions over a range: reproducible, and as parallel as the range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, row: Column) -> Column:
    """A number in [0, 1) that depends on seed and row alone."""
    return F.pmod(F.xxhash64(F.lit(seed), row), F.lit(1 << 53)) / float(1 << 53)


def zipf_keys(df: DataFrame, n_keys: int, exponent: float = 1.0, seed: int = 0, row: str = "id", out: str = "key") -> DataFrame:
    """Add a key in [0, n_keys) with Zipf-like frequencies, by the inverse of the continuous distribution function."""
    u = uniform(seed, F.col(row))
    if abs(exponent - 1) < 1e-9:
        x = F.pow(F.lit(float(n_keys + 1)), u)
    else:
        e = 1 - exponent
        x = F.pow((F.pow(F.lit(float(n_keys + 1)), F.lit(e)) - 1) * u + 1, F.lit(1 / e))
    return df.withColumn(out, F.least(F.floor(x) - 1, F.lit(n_keys - 1)).cast("long"))


def zipf(spark: SparkSession, rows: int, n_keys: int, exponent: float = 1.0, seed: int = 0) -> DataFrame:
    return zipf_keys(spark.range(rows), n_keys, exponent, seed)


def zipf_stream(spark: SparkSession, rows_per_second: int, n_keys: int, exponent: float = 1.0, seed: int = 0) -> DataFrame:
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return zipf_keys(rate, n_keys, exponent, seed, row="value")


def choices(df: DataFrame, values: list[str], out: str = "word", seed: int = 0, row: str = "id") -> DataFrame:
    """Add one of ``values`` to each row, evenly."""
    picked = F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(uniform(seed, F.col(row)) * len(values)) + 1).cast("int"))
    return df.withColumn(out, picked)
