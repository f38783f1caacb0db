"""Row functions and filters. Functions that give an array emit one row per element when used with ``each``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_words(text: Column) -> Column:
    """Words between single spaces, empty ones left out."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def split_fields(text: Column) -> Column:
    """Parts between single spaces; inner empty parts stay, trailing ones go."""
    return F.split(F.rtrim(text), " ")


def string_length(text: Column) -> Column:
    return F.length(text)


def parse_rows(args: Column) -> Column:
    """A JSON list of lists as an array of string arrays."""
    return F.from_json(args, "array<array<string>>")


def exclaim(text: Column) -> Column:
    return F.concat(text, F.lit("!!!"))


def prefixes_before(text: Column, letter: str = "a") -> Column:
    """The prefix before each occurrence of ``letter``."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.lit(1)) == letter)
    return F.transform(at, lambda i: F.substr(text, F.lit(1), i - 1))


def square(number: Column) -> Column:
    return number * number


def not_null(columns: Sequence[Column]) -> Column:
    """True if none of ``columns`` is null."""
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def all_equal(columns: Sequence[Column]) -> Column:
    """True if all ``columns`` are equal; null equals null."""
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in zip(columns, columns[1:], strict=False)], F.lit(True))


def negate(condition: Column) -> Column:
    """True where ``condition`` is false or null."""
    return ~F.coalesce(condition, F.lit(False))


def always(_: Sequence[Column] = ()) -> Column:
    return F.lit(True)
