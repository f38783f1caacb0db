"""Exact top-k inner-product search with a vector-approximation file.

The file holds one byte per dimension for each distinct vector: the number of the quantised cell it falls
in. A scan of the file bounds every score from above and below. Exact vectors are then read in the order of
their bounds, in two waves: the first settles a k-th score, the second reads whatever might still beat it.

Cells split the bulk of each dimension evenly; the outermost two take whatever lies outside, so that a few
far-out vectors don't coarsen the cells of all others.

Queries are taken in blocks of a bounded size, each against all rows; only such a block is ever broadcast.
Equal vectors are one item that carries its smallest ids, so copies cost nothing. An id with several
different vectors is one item with several vectors.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm.common import discard, save, scratch_path

#: Bytes of query vectors in a block, which are broadcast.
BLOCK_BYTES = 16 << 20
#: Fixed value: scale of the integer components.
SCALE = 256
#: Share of the vectors beyond either end of a dimension's evenly split bulk, about.
TAIL = 0.002
_RESULT = "query_id long, rank int, vec_id long, score long"


@dataclass(frozen=True)
class Numbers:
    """How components are stored and bounded.

    Narrow: 32-bit integers, if no product can leave 64 bits. Wide: the doubles themselves; exact scores are then
    taken in unbounded integers, and bounds in units of 2**shift so that nothing overflows.
    """

    dims: int
    wide: bool
    shift: int

    @classmethod
    def fitting(cls, dims: int, largest: float) -> Numbers:
        top = SCALE * int(largest) + SCALE
        wide = top >= 1 << 31 or dims * top * top >= 1 << 63
        return cls(dims, wide, math.frexp(largest)[1] + 8 if wide else 0)

    @property
    def kind(self) -> str:
        return "<f8" if self.wide else "<i4"

    @property
    def ceiling(self) -> float:
        """The largest score, in the units of bounds."""
        return math.ldexp(1.0, 63 - 2 * self.shift)

    def stored(self, x: np.ndarray) -> np.ndarray:
        return x + 0.0 if self.wide else np.floor(x * SCALE).astype(np.int32)

    def read(self, blobs: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(blobs), self.kind).reshape(-1, self.dims)

    def floats(self, v: np.ndarray) -> np.ndarray:
        """Integer components in the units of bounds."""
        if not self.wide:
            return v.astype(np.float64)
        small = np.abs(v) < 2.0**52
        return np.where(small, np.ldexp(np.floor(np.where(small, v, 0.0) * SCALE), -self.shift), np.ldexp(v, 8 - self.shift))

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products of the rows of ``a`` and ``b``; beyond 64 bits the nearest 64-bit number."""
        if not self.wide:
            return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
        whole = lambda row: [math.floor(x * SCALE) if abs(x) < 2.0**52 else SCALE * int(x) for x in row.tolist()]
        exact = (sum(map(operator.mul, whole(x), whole(y))) for x, y in zip(a, b, strict=True))
        return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact], np.int64)


@dataclass(frozen=True)
class Cells:
    """Cell borders of every dimension: ``low`` to ``start``, 254 of ``width`` from ``start`` to ``end``, ``end`` to ``high``."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    high: np.ndarray

    @property
    def width(self) -> np.ndarray:
        return np.maximum((self.end - self.start) / 254, np.finfo(float).tiny)

    def of(self, f: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            inner = np.clip(np.floor((f - self.start) / self.width), 0, 253) + 1
        return np.where(f < self.start, 0, np.where(f > self.end, 255, inner)).astype(np.uint8)

    def centres(self, cells: np.ndarray) -> np.ndarray:
        inner = self.start + (cells - 0.5) * self.width
        return np.where(cells == 0, (self.low + self.start) / 2, np.where(cells == 255, (self.end + self.high) / 2, inner))

    def halves(self, cells: np.ndarray) -> np.ndarray:
        return np.where(cells == 0, (self.start - self.low) / 2, np.where(cells == 255, (self.high - self.end) / 2, self.width / 2))

    @property
    def slack(self) -> np.ndarray:
        """Room for the rounding of borders and products, for a query component of 1."""
        return np.maximum(np.abs(self.low), np.abs(self.high)) * (len(self.low) + 8) * 2.0**-48


def _stored(rows: DataFrame, numbers: Numbers) -> DataFrame:
    """(vec_id, v, asks): components as ``numbers`` stores them, padded with zeros."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = batch.column("x")
            lengths = np.diff(x.offsets.to_numpy())
            flat = x.flatten().to_numpy(zero_copy_only=False)
            v = np.zeros((len(lengths), numbers.dims), numbers.kind)
            v[np.arange(numbers.dims)[None, :] < lengths[:, None]] = numbers.stored(flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in v], pa.binary()), batch.column("asks")], names=["vec_id", "v", "asks"])

    return rows.mapInArrow(run, "vec_id long, v binary, asks boolean")


def _cells(vectors: DataFrame, numbers: Numbers) -> Cells | None:
    """Borders from all vectors: least and largest component, and where the bulk lies (the median over partitions)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts = []
        for batch in batches:
            if batch.num_rows:
                f = numbers.floats(numbers.read(batch.column("v").to_pylist()))
                parts.append(np.stack([f.min(axis=0), *np.quantile(f, [TAIL, 1 - TAIL], axis=0), f.max(axis=0)]))
        if parts:
            low, start, end, high = np.stack(parts).transpose(1, 0, 2)
            columns = [low.min(axis=0), np.median(start, axis=0), np.median(end, axis=0), high.max(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(range(numbers.dims), pa.int32()), *map(pa.array, columns)], names=["d", "low", "start", "end", "high"])

    borders = vectors.select("v").mapInArrow(run, "d int, low double, start double, end double, high double").groupBy("d")
    middle = lambda c: F.percentile_approx(c, 0.5).alias(c)
    rows = borders.agg(F.min("low").alias("low"), middle("start"), middle("end"), F.max("high").alias("high")).orderBy("d").collect()  # a row a dimension
    if not rows:
        return None
    low, start, end, high = (np.array([r[c] for r in rows]) for c in ("low", "start", "end", "high"))
    margin = (end - start) / 4
    return Cells(low, np.clip(start - margin, low, high), np.clip(end + margin, low, high), high)


def _approximate(items: DataFrame, numbers: Numbers, cells: Cells) -> DataFrame:
    """(item, print, first, cells): the approximation file."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                found = cells.of(numbers.floats(numbers.read(batch.column("v").to_pylist())))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("item", "print", "first")), pa.array([c.tobytes() for c in found], pa.binary())],
                                                 names=["item", "print", "first", "cells"])

    return items.select("item", "print", "first", "v").mapInArrow(run, "item long, print long, first boolean, cells binary")


def _bounded(file: DataFrame, block, k: int, numbers: Numbers, cells: Cells) -> DataFrame:
    """(q, item, print, first, low, high): of every query of the block, the vectors that this part of the file can't
    rule out. A score lies from ``low`` to ``high``. Only an item's first vector counts for the k-th bound, so that
    the bound is one over items."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        queries = numbers.floats(block.value)
        size, top = np.abs(queries), numbers.ceiling
        rounding = size @ cells.slack
        even = size @ (cells.width / 2) + rounding
        best = np.full((len(queries), k), -np.inf)
        held: list[tuple] = []
        for batch in batches:
            items, prints, firsts, blobs = (batch.column(c) for c in ("item", "print", "first", "cells"))
            items, prints, firsts, blobs = items.to_numpy(), prints.to_numpy(), firsts.to_numpy(zero_copy_only=False), blobs.to_pylist()
            for at in range(0, len(items), 2048):
                some = np.frombuffer(b"".join(blobs[at:at + 2048]), np.uint8).reshape(-1, numbers.dims)
                centres, first = cells.centres(some), firsts[at:at + 2048]
                outer = np.flatnonzero(((some == 0) | (some == 255)).any(axis=1))
                halves = cells.halves(some[outer])
                for a in range(0, len(queries), 1024):
                    s = queries[a:a + 1024] @ centres.T
                    spread = np.repeat(even[a:a + 1024, None], len(some), axis=1)
                    spread[:, outer] = size[a:a + 1024] @ halves.T + rounding[a:a + 1024, None]
                    low, high = np.clip(s - spread, -top, top), np.clip(s + spread, -top, top)
                    both = np.concatenate([best[a:a + 1024], np.where(first, low, -np.inf)], axis=1)
                    best[a:a + 1024] = -np.partition(-both, k - 1, axis=1)[:, :k]
                    q, e = np.nonzero(high >= best[a:a + 1024].min(axis=1)[:, None])
                    held.append(((q + a).astype(np.int32), items[at + e], prints[at + e], first[e], low[q, e], high[q, e]))
            if sum(len(h[0]) for h in held) > 1_000_000:
                held = [_still(held, best)]
        if held:
            found = _still(held, best)
            for at in range(0, len(found[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at:at + 100_000]) for x in found], names=["q", "item", "print", "first", "low", "high"])

    return file.mapInArrow(run, "q int, item long, print long, first boolean, low double, high double")


def _still(held: list[tuple], best: np.ndarray) -> tuple:
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    keep = columns[5] >= best[columns[0]].min(axis=1)
    return tuple(c[keep] for c in columns)


def _exact(pairs: DataFrame, items: DataFrame, block, numbers: Numbers) -> DataFrame:
    """(q, item, score, near): exact scores of the pairs, from the vectors themselves; ``near`` in the units of bounds."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                score = numbers.scores(block.value[batch.column("q").to_numpy()], numbers.read(batch.column("v").to_pylist()))
                near = np.ldexp(score.astype(np.float64), -2 * numbers.shift)
                near = near - np.abs(near) * 2.0**-50
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("item"), pa.array(score), pa.array(near)], names=["q", "item", "score", "near"])

    read = pairs.select("q", "item", "print").join(items.select("item", "print", "v"), ["item", "print"]).select("q", "item", "v")
    return read.mapInArrow(run, "q int, item long, score long, near double").groupBy("q", "item").agg(F.max("score").alias("score"), F.max("near").alias("near"))


def _items(vectors: DataFrame, k: int) -> DataFrame:
    """(item, print, first, v, ids) of the vectors (vec_id, v, lead), which are distinct: ``item`` is the smallest id
    that has the vector; (item, print) names a vector; ``ids`` are the k + 1 smallest ids of the item. ``lead`` is null
    for ids with one vector, else the hash of the first of theirs."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    alone = vectors.filter(F.col("lead").isNull()).withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    alone = alone.groupBy("v").agg(F.min("vec_id").alias("item"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    alone = alone.select("item", F.lit(0).cast("long").alias("print"), F.lit(True).alias("first"), "v", "ids")
    many = vectors.filter(F.col("lead").isNotNull())
    many = many.select(F.col("vec_id").alias("item"), F.xxhash64("v").alias("print"), (F.xxhash64("v") == F.col("lead")).alias("first"), "v", F.array("vec_id").alias("ids"))
    return save(alone.unionByName(many), "items")


def _answered(spark: SparkSession, file: DataFrame, items: DataFrame, rows: list, k: int, numbers: Numbers, cells: Cells, path: str) -> None:
    """Append (item_, print_, hits) of one block of query vectors to ``path``: their k + 1 best items."""
    names = spark.createDataFrame([(i, r["item"], r["print"]) for i, r in enumerate(rows)], "q int, item_ long, print_ long")
    block = spark.sparkContext.broadcast(numbers.read([bytes(r["v"]) for r in rows]))
    near = save(_bounded(file, block, k + 1, numbers, cells), "bounds")
    by = lambda c, *ties: Window.partitionBy("q").orderBy(F.col(c).desc(), *ties)
    kth = lambda df, c: df.withColumn("nth", F.row_number().over(by(c))).filter(F.col("nth") == k + 1).select("q", F.col(c).alias("kth"))
    open_ = near.join(kth(near.filter("first"), "low"), "q", "left").filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).drop("kth")
    open_ = save(open_.withColumn("nth", F.row_number().over(by("high", "item", "print"))), "candidates")
    first = save(_exact(open_.filter(F.col("nth") <= 2 * (k + 1)), items, block, numbers), "exact")
    second = open_.filter(F.col("nth") > 2 * (k + 1)).join(kth(first, "near"), "q", "left").filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth")))
    scored = first.unionByName(_exact(second, items, block, numbers)).groupBy("q", "item").agg(F.max("score").alias("score"))
    top = scored.withColumn("nth", F.row_number().over(by("score", "item"))).filter(F.col("nth") <= k + 1)
    top = top.join(items.filter("first").select("item", "ids"), "item")
    hits = top.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))  # k + 1 a query
    hits.join(F.broadcast(names), "q").select("item_", "print_", "hits").write.mode("append").parquet(path)
    discard(near, open_, first)
    block.unpersist()


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` ids of ``vectors`` (vec_id, embedding) with the highest integer
    inner product with each id for which ``is_query`` holds, itself excepted; ties to smaller vec_id.

    Components are floor(256 * x), of any size; scores are exact, and one beyond 64 bits counts as the nearest
    64-bit number. Vectors that are null or hold a null or non-finite component take no part; shorter vectors count
    as padded with zeros. Null vec_ids take no part. Rows that share a vec_id are one candidate, and one query:
    the score of two ids is the highest over their vectors, so that no id comes twice. Fewer than ``k``
    candidates: all. Other columns are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = vectors.filter(F.coalesce(fine, F.lit(False)))
    most = F.max(F.array_max(F.transform("embedding", lambda c: F.abs(c.cast("double")))))
    dims, largest = usable.agg(F.max(F.size("embedding")), most).first()
    if dims is None:
        return spark.createDataFrame([], _RESULT)
    numbers = Numbers.fitting(max(1, dims), largest or 0.0)
    rows = usable.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    distinct = _stored(rows, numbers).groupBy("vec_id", "v").agg(F.max("asks").alias("asks"))
    of_id = distinct.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("v")).alias("lead"), F.max("asks").alias("asks"))
    of_id = of_id.select("vec_id", F.when(F.col("n") > 1, F.col("lead")).alias("lead"), "asks")
    stored = save(distinct.drop("asks").join(of_id, "vec_id"), "vectors")
    items = _items(stored, k)
    cells = _cells(items, numbers)
    file = save(_approximate(items, numbers, cells), "approximations")

    # Query vectors by the names of their items, in blocks of a bounded size.
    asking = stored.filter("asks")
    alone = asking.filter(F.col("lead").isNull()).join(items.filter("print = 0").select("v", "item"), "v").select(F.col("vec_id").alias("query_id"), "item", F.lit(0).cast("long").alias("print"))
    many = asking.filter(F.col("lead").isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("item"), F.xxhash64("v").alias("print"))
    asked = save(alone.unionByName(many), "queries")
    wanted = asked.select("item", "print").distinct()
    n = wanted.count()
    if not n:
        return spark.createDataFrame([], _RESULT)
    blocks = math.ceil(n * numbers.dims * 8 / BLOCK_BYTES)
    wanted = wanted.join(items, ["item", "print"]).select("item", "print", "v")
    path = scratch_path(spark, "hits")
    for b in range(blocks):
        some = wanted.filter(F.pmod(F.xxhash64("item", "print"), F.lit(blocks)) == b).orderBy("item", "print").collect()  # about BLOCK_BYTES
        if some:
            _answered(spark, file, items, some, k, numbers, cells, path)
    discard(stored, file)
    answers = spark.read.schema("item_ long, print_ long, hits array<struct<score long, ids array<long>>>").parquet(path)
    flat = F.flatten(F.transform("hits", lambda e: F.transform(e["ids"], lambda i: F.struct(F.bitwise_not(e["score"]).alias("less"), i.alias("id")))))
    others = F.slice(F.array_sort(F.filter(flat, lambda c: c["id"] != F.col("query_id"))), 1, k)
    out = asked.join(answers, (F.col("item") == F.col("item_")) & (F.col("print") == F.col("print_"))).select("query_id", F.explode(others).alias("hit"))
    out = out.groupBy("query_id", F.col("hit.id").alias("vec_id")).agg(F.max(F.bitwise_not("hit.less")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
