"""Aggregators: built-in ones as native expressions, user-written ones as Arrow-batched Python.

A native aggregator has a zero, the answer for an empty batch. Groups that do not occur have no answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Native:
    """``expr`` aggregates rows; ``merge`` combines two such results (for keyed state). ``many``: the result is
    an array of which each element is a row of its own."""

    expr: Column
    zero: Any
    merge: Callable[[Column, Column], Column]
    many: bool = False


def count() -> Native:
    return Native(F.count(F.lit(1)), 0, lambda a, b: a + b)


def total(column: str | Column) -> Native:
    """Sum; 0 for nothing. Nulls are skipped."""
    column = F.col(column) if isinstance(column, str) else column
    return Native(F.coalesce(F.sum(column), F.lit(0)), 0, lambda a, b: a + b)


def one() -> Native:
    """Always 1: grouped, it lists the distinct keys."""
    return Native(F.max(F.lit(1)), 1, lambda a, b: F.lit(1))


def collect(column: str | Column) -> Native:
    """Every value, as a row of its own, in ascending order."""
    column = F.col(column) if isinstance(column, str) else column
    return Native(F.sort_array(F.collect_list(column)), None, lambda a, b: F.sort_array(F.concat(a, b)), many=True)


@dataclass(frozen=True)
class Combiner:
    """User-written and associative: ``init(row)``, ``combine(a, b)``, ``zero()``; combined in each partition first."""

    init: Callable[[dict], Any]
    combine: Callable[[Any, Any], Any]
    zero: Callable[[], Any]
    type: str


@dataclass(frozen=True)
class Reducer:
    """User-written: ``init()`` and ``reduce(current, row)``, over the rows of one group in the given order."""

    init: Callable[[], Any]
    reduce: Callable[[Any, dict], Any]
    type: str


@dataclass(frozen=True)
class General:
    """User-written: the rows of one group in, any number of result tuples out. ``schema`` is a DDL string."""

    run: Callable[[Iterable[dict]], Iterable[tuple]]
    schema: str
