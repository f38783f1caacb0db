"""Schemes: bytes to fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def raw(df: DataFrame, value: str = "value") -> DataFrame:
    return df.select(F.col(value).alias("bytes"))


def text(df: DataFrame, value: str = "value", out: str = "str", charset: str = "UTF-8") -> DataFrame:
    return df.withColumn(out, F.decode(F.col(value), charset)).drop(value)


def json(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """One tuple a message; malformed messages give nulls."""
    parsed = F.from_json(F.decode(F.col(value), "UTF-8"), schema)
    return df.withColumn("__row", parsed).select(*[c for c in df.columns if c != value], "__row.*")


def json_rows(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Any number of tuples a message: a JSON list of objects."""
    parsed = F.from_json(F.decode(F.col(value), "UTF-8"), f"array<struct<{schema}>>")
    return df.select(*[c for c in df.columns if c != value], F.inline(parsed))


def delimited(df: DataFrame, schema: str, value: str = "value", sep: str = ",") -> DataFrame:
    parsed = F.from_csv(F.decode(F.col(value), "UTF-8"), schema, {"sep": sep})
    return df.withColumn("__row", parsed).select(*[c for c in df.columns if c != value], "__row.*")


def key_value(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))
