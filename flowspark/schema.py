"""Field checks made when a pipeline is built, not when it runs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_fields(names: Sequence[str]) -> list[str]:
    """``names`` as a list; raises ValueError if one occurs twice."""
    twice = sorted({n for n in names if list(names).count(n) > 1})
    if twice:
        raise ValueError(f"duplicate fields: {twice}")
    return list(names)


def require(df: DataFrame, names: Iterable[str]) -> list[str]:
    """``names`` as a list; raises ValueError if ``df`` lacks one."""
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown fields {missing}; available: {df.columns}")
    return names


def fresh(df: DataFrame, names: Iterable[str]) -> list[str]:
    """``names`` as a list; raises ValueError if ``df`` has one already."""
    names = distinct_fields(list(names))
    taken = [n for n in names if n in df.columns]
    if taken:
        raise ValueError(f"fields exist already: {taken}")
    return names


def same_key(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]]) -> Column:
    """Equality of keys in which null matches null."""
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])
