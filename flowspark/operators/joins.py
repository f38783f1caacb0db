"""Equi-joins in which null keys match, with a join type for each side, and reducers over several streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.stream import Stream
from flowspark.schema import distinct_fields, require, same_key

INNER, OUTER = "inner", "outer"
#: Fixed value: about as many rows of one side and key are dealt to tasks together by joins of many to many.
BLOCK = 512
_TWO = {(INNER, INNER): "inner", (INNER, OUTER): "left", (OUTER, INNER): "right", (OUTER, OUTER): "full"}


def _same_keys(left: DataFrame, i: int, right: DataFrame, j: int, n_keys: int) -> Column:
    return same_key(left, right, [(f"k{x}_{i}", f"k{x}_{j}") for x in range(n_keys)])


def _one_by_one(tables: Sequence[DataFrame], n_keys: int, types: Sequence[str]) -> DataFrame:
    df, so_far = tables[0], types[0]
    for i, table in enumerate(tables[1:], 1):
        # A row so far has every INNER side; with one of them, what it has no partner for may only be missing.
        how = _TWO[so_far, types[i]]
        so_far = INNER if INNER in (so_far, types[i]) else OUTER
        df = df.join(table, _same_keys(df, 0, table, i, n_keys), how)
        if how in ("right", "full"):
            # Null keys may be real: take the key of whichever side is there.
            df = df.withColumns({f"k{j}_0": F.coalesce(f"k{j}_0", f"k{j}_{i}") for j in range(n_keys)})
    return df


def _in_cells(tables: Sequence[DataFrame], n_keys: int, width: Sequence[int]) -> DataFrame:
    """Inner join by cells: one block of rows of each side, all of one key. Cells are dealt to tasks evenly and
    expanded there. Only the keys with more than BLOCK rows of a side are broadcast, at most one in BLOCK rows.

    Rows go to blocks by their place in the input, which has to be the same if a task runs again (as in files).
    """
    cells = None
    for i, table in enumerate(tables):
        keys = [f"k{j}_{i}" for j in range(n_keys)]
        large = table.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks")).filter("n_blocks > 1")
        large = large.select(*[F.col(k).alias(f"k{j}_large") for j, k in enumerate(keys)], "n_blocks")
        placed = table.withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
        placed = placed.join(F.broadcast(large), _same_keys(placed, i, large, "large", n_keys), "left")
        block = F.pmod("place", F.coalesce("n_blocks", F.lit(1)))
        # Structs, for lists leave nulls out.
        row = F.struct(*([f"v{j}_{i}" for j in range(width[i])] or [F.lit(0).alias("none")]))
        blocks = placed.groupBy(*keys, block.alias("block")).agg(F.collect_list(row).alias(f"rows_{i}")).drop("block")
        if width[i] == 1:
            blocks = blocks.withColumn(f"rows_{i}", F.col(f"rows_{i}.v0_{i}"))
        cells = blocks if cells is None else cells.join(blocks, _same_keys(cells, 0, blocks, i, n_keys))
    # A number that is asked for: partitions without one are put together by size.
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df, done = cells.repartition(n), [f"k{j}_0" for j in range(n_keys)]
    for i, w in enumerate(width):
        mine, later = [f"v{j}_{i}" for j in range(w)], [f"rows_{x}" for x in range(i + 1, len(width))]
        df = df.select(*done, *later, F.explode(f"rows_{i}").alias("row"))
        df = df.select(*done, *([F.col("row").alias(*mine)] if w == 1 else [F.col(f"row.{v}") for v in mine]), *later)
        if later:
            # Moves nothing, but ends the generated function, which holds all that one row becomes until it returns.
            df = df.coalesce(n)
        done += mine
    return df


def join(sides: Sequence[tuple[Stream, Sequence[str]]], out: Sequence[str], types: Sequence[str] | None = None, many: bool = False) -> Stream:
    """Join streams on the fields given with each. Output: the key fields, then the other fields of each stream in
    order, renamed to ``out``; per batch if all have a batch column.

    ``types[i]`` says whether side i may be missing (OUTER: its fields are then null) or not (INNER, the
    default): [INNER, OUTER] is a left join. Null keys match each other.

    ``many`` is for inner joins in which a key has many rows on several sides: Spark cuts tasks by the size of their
    input, so that one task would make most of a result that is far larger. Work is then dealt by result rows.
    """
    types = list(types or [INNER] * len(sides))
    if len(sides) < 2 or len(types) != len(sides) or len({len(f) for _, f in sides}) != 1:
        raise ValueError("two or more sides, a type for each, and as many key fields in each")
    if many and OUTER in types:
        raise ValueError("joins of many to many are inner joins")
    batch = sides[0][0].batch if all(s.batch for s, _ in sides) else None
    tables, width = [], []
    for i, (stream, fields) in enumerate(sides):
        require(stream.df, distinct_fields(fields))
        keys = [*([stream.batch] if batch else []), *fields]
        rest = [c for c in stream.df.columns if c not in keys and c != stream.batch]
        width.append(len(rest))
        tables.append(stream.df.select(*[F.col(k).alias(f"k{j}_{i}") for j, k in enumerate(keys)], *[F.col(r).alias(f"v{j}_{i}") for j, r in enumerate(rest)]))
    n_keys = len(sides[0][1]) + bool(batch)
    df = _in_cells(tables, n_keys, width) if many else _one_by_one(tables, n_keys, types)
    columns = [f"k{j}_0" for j in range(n_keys)] + [f"v{j}_{i}" for i, w in enumerate(width) for j in range(w)]
    names = [*([sides[0][0].batch] if batch else []), *distinct_fields(out)]
    if len(names) != len(columns):
        raise ValueError(f"{len(columns) - bool(batch)} output fields, {len(out)} names")
    return Stream(df.select(*columns).toDF(*names), batch)


def natural_join(sides: Sequence[Stream], out: Sequence[str]) -> Stream:
    """Inner join of streams on the fields that all have in common; ``out`` picks the fields of the result."""
    common = [f for f in sides[0].output_fields if all(f in s.output_fields for s in sides)]
    if not common:
        raise ValueError("no common field")
    rest = [f for s in sides for f in s.output_fields if f not in common]
    return join([(s, common) for s in sides], [*common, *rest]).project(*out)


def multi_reduce(sides: Sequence[tuple[Stream, Sequence[str]]], function: Callable[[tuple, list[list[dict]]], Iterable[tuple]], schema: str) -> Stream:
    """A user-written reducer over several streams: called once per key with the rows of each stream, as lists of
    dicts, yields result tuples. No key fields: one call per batch, or one in all. ``schema``: DDL of the results,
    which follow the key fields (named as in the first stream)."""
    keys = list(sides[0][1])
    batch = sides[0][0].batch if all(s.batch for s, _ in sides) else None
    grouped = ([batch] if batch else []) + keys
    united, fields = None, []
    for i, (stream, side_keys) in enumerate(sides):
        require(stream.df, side_keys)
        own = [c for c in stream.df.columns if c != stream.batch]
        fields.append(own)
        named = ([F.col(stream.batch).alias(batch)] if batch else []) + [F.col(k).alias(f"__k{j}") for j, k in enumerate(side_keys)]
        part = stream.df.select(*named, F.lit(i).alias("__side"), *[F.col(c).alias(f"__{i}_{c}") for c in own])
        united = part if united is None else united.unionByName(part, allowMissingColumns=True)
    group_columns = ([batch] if batch else []) + [f"__k{j}" for j in range(len(keys))]
    if not group_columns:
        united, group_columns = united.withColumn("__all", F.lit(0)), ["__all"]
    first = sides[0][0].df.schema
    result = T.StructType([*[first[c] for c in grouped], *T.StructType.fromDDL(schema).fields])

    def run(group):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        rows: list[list[dict]] = [[] for _ in fields]
        for row in group.to_pylist():
            i = row["__side"]
            rows[i].append({c: row[f"__{i}_{c}"] for c in fields[i]})
        key = tuple(group.column(c)[0].as_py() for c in group_columns) if grouped else ()
        emitted = [(*key, *r) for r in function(key[1:] if batch else key, rows)]
        kinds = to_arrow_schema(result)
        columns = list(zip(*emitted, strict=True)) if emitted else [()] * len(result)
        return pa.Table.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(columns)], schema=kinds)

    return Stream(united.groupBy(*group_columns).applyInArrow(run, result), batch)
