"""Lookups of stream rows in a state snapshot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.schema import fresh, require


def map_get(rows: DataFrame, state: DataFrame, on: Sequence[tuple[str, str]], value: str, out: str) -> DataFrame:
    """Append the value of each row's key, null if the state has none. ``on``: (row field, state key) pairs."""
    require(rows, [a for a, _ in on])
    require(state, [*[b for _, b in on], value])
    fresh(rows, [out])
    side = state.select(*[F.col(b).alias(f"__{b}") for _, b in on], F.col(value).alias(out))
    condition = None
    for a, b in on:
        one = rows[a].eqNullSafe(side[f"__{b}"])
        condition = one if condition is None else condition & one
    return rows.join(side, condition, "left").select(*rows.columns, out)


def snapshot_get(rows: DataFrame, state: DataFrame, value: str, out: str) -> DataFrame:
    """Append the one value of a state without keys; null if there is none."""
    fresh(rows, [out])
    single = state.agg(F.first(value).alias(out))  # one row always
    return rows.crossJoin(F.broadcast(single))


def collection_get(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Append every row of the state to each row: a full scan for each request. Requests are few; the larger side
    isn't copied if the smaller is under the session's broadcast limit."""
    fresh(rows, state.columns)
    return rows.crossJoin(state)


def apply_query(rows: DataFrame, state: DataFrame, function: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A user-written query: gets the rows and the snapshot, gives the rows with fields appended."""
    out = function(rows, state)
    require(out, rows.columns)
    return out
