"""Shard and route analysis: how load spreads over keys, shards and routes, and plans to even it out."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults of the elastic settings.
SHARDS = 256
SKEW_THRESHOLD = 0.2
OVER_PROVISION = 1.5
#: What is not routed to one of the local routes.
REMOTE = -2


def shard_of(key: Column, shards: int = SHARDS, hashed: bool = False) -> Column:
    """A key's shard. Whole-number keys are their own hash; others (``hashed``) take Spark's. Never negative."""
    return F.pmod(F.hash(key) if hashed else key, F.lit(shards)).cast("int")


def hash_route(key: Column, routes: int, hashed: bool = False) -> Column:
    return shard_of(key, routes, hashed)


def initial_mapping(shards: int, routes: int) -> dict[int, int]:
    return {s: s % routes for s in range(shards)}


def route(df: DataFrame, key: Column, mapping: dict[int, int], shards: int = SHARDS, hashed: bool = False) -> DataFrame:
    """Add ``shard`` and ``route`` by a table of at most ``shards`` rows."""
    table = F.broadcast(df.sparkSession.createDataFrame(sorted(mapping.items()), "shard int, route int"))
    return df.withColumn("shard", shard_of(key, shards, hashed)).join(table, "shard")


def partial_route(column: Column, exceptions: Sequence[int]) -> Column:
    """The route, or REMOTE where it is one of ``exceptions``."""
    return F.when(column.isin(*exceptions), F.lit(REMOTE)).otherwise(column) if exceptions else column


def histogram(df: DataFrame, column: str, n: int) -> DataFrame:
    """(column, load) for each number in [0, n), 0 where there are no rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("load"))
    numbers = df.sparkSession.range(n).select(F.col("id").cast("int").alias(column))
    return numbers.join(counts, column, "left").select(column, F.coalesce("load", F.lit(0)).alias("load"))


def skewness(loads: DataFrame, threshold: float = SKEW_THRESHOLD) -> DataFrame:
    """(skew, skewed): (largest - smallest) / largest of the loads; 0 if all are 0."""
    skew = F.when(F.max("load") > 0, (F.max("load") - F.min("load")) / F.max("load")).otherwise(F.lit(0.0))
    return loads.agg(skew.alias("skew")).withColumn("skewed", F.col("skew") >= threshold)


def performance(loads: DataFrame) -> DataFrame:
    """(factor, largest): the least of min(1, mean / load) over loads other than 0, and the largest load."""
    live = loads.filter(F.col("load") != 0)
    return live.agg(F.least(F.lit(1.0), F.avg("load") / F.max("load")).alias("factor"), F.max("load").alias("largest"))


def pack_decreasing(loads: dict[int, int], bins: int) -> dict[int, int]:
    """Shard to bin: the largest shard first, each to the least loaded bin; ties to the smaller number."""
    used = [0] * bins
    plan = {}
    for shard, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        target = min(range(bins), key=lambda b: (used[b], b))
        plan[shard] = target
        used[target] += load
    return plan


def rebalance(loads: dict[int, int], mapping: dict[int, int], bins: int) -> list[tuple[int, int, int]]:
    """(shard, from, to): few moves that even out the bins. While the fullest bin has a shard smaller than its lead
    over the emptiest, the largest such shard moves there."""
    now = dict(mapping)
    used = [0] * bins
    for shard, b in now.items():
        used[b] += loads.get(shard, 0)
    while True:
        full = max(range(bins), key=lambda b: (used[b], -b))
        empty = min(range(bins), key=lambda b: (used[b], b))
        lead = used[full] - used[empty]
        fits = [(loads.get(s, 0), -s) for s, b in now.items() if b == full and 0 < loads.get(s, 0) < lead]
        if not fits:
            return sorted((s, mapping[s], b) for s, b in now.items() if b != mapping[s])
        load, shard = max(fits)
        now[-shard] = empty
        used[full] -= load
        used[empty] += load


def plan_moves(df: DataFrame, key: Column, routes: int, shards: int = SHARDS, hashed: bool = False) -> DataFrame:
    """(shard, from_route, to_route): the moves that even out the routes, from loads of at most ``shards`` rows."""
    counts = df.groupBy(shard_of(key, shards, hashed).alias("shard")).count().collect()  # at most ``shards`` rows
    moves = rebalance({r["shard"]: r["count"] for r in counts}, initial_mapping(shards, routes), routes)
    return df.sparkSession.createDataFrame(moves, "shard int, from_route int, to_route int")


def predict_parallelism(rate: float, capacity: float, current: int, factor: float = 1.0, over: float = OVER_PROVISION) -> int:
    """Tasks needed for ``rate`` at ``capacity`` per task and an efficiency ``factor``, with spare room; at most one
    step away from ``current`` at a time."""
    needed = max(1, math.ceil(over * rate / (capacity * max(factor, 1e-9)))) if capacity > 0 else current
    return max(1, min(current + 1, max(current - 1, needed)))
