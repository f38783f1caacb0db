"""How rows are dealt to partitions, and aggregation that stands up to skewed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.aggregates import Native
from flowspark.shared import free_name


def shuffle(df: DataFrame, n: int | None = None) -> DataFrame:
    """Even, round-robin."""
    return df.repartition(n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_fields(df: DataFrame, fields: Sequence[str], n: int | None = None) -> DataFrame:
    """Equal fields, same partition."""
    return df.repartition(n, *fields) if n else df.repartition(*fields)


def random(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return df.repartition(n, F.rand(seed))


def custom(df: DataFrame, target: Column, n: int) -> DataFrame:
    """``target``: a partition number, or an array of them, one copy of the row for each. Kept as ``target``."""
    df = df.withColumn("target", target)
    if df.schema["target"].dataType.typeName() == "array":
        df = df.withColumn("target", F.explode("target"))
    return df.repartition(n, "target")


def single(df: DataFrame) -> DataFrame:
    """All rows in one partition. Aggregates don't need this: they combine per partition first."""
    return df.coalesce(1)


def replicate(df: DataFrame, n: int) -> DataFrame:
    """A copy of each row for each of ``n`` targets, numbered in ``target``."""
    return df.withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def index_hash(column: Column, n: int) -> Column:
    """A partition number in [0, n) from one field; never negative."""
    return F.pmod(F.hash(column), F.lit(n))


def two_phase(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[Native, str]], salts: int = 2) -> DataFrame:
    """Aggregate by (key, salt), then merge by key with each aggregator's own merge, so that at most a ``salts``-th of a
    hot key's rows meet in one task. Equal to plain aggregation; aggregators of many rows give them as arrays."""
    salt, parts = free_name(df, "salt"), "parts"
    first = df.withColumn(salt, F.pmod(F.xxhash64(*df.columns), F.lit(salts))).groupBy(*keys, salt).agg(*[a.expr.alias(n) for a, n in pairs])
    gathered = first.groupBy(*keys).agg(F.collect_list(F.struct(*[n for _, n in pairs])).alias(free_name(first, parts)))  # ``salts`` rows a key
    parts = gathered.columns[-1]

    def merged(aggregator: Native, name: str) -> Column:
        values = F.transform(parts, lambda p: p[name])
        return F.reduce(F.slice(values, 2, salts), F.get(values, F.lit(0)), aggregator.merge).alias(name)

    return gathered.select(*keys, *[merged(a, n) for a, n in pairs])
