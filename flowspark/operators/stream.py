"""Stream and GroupedStream: immutable, lazy wrappers that add field checks and per-batch semantics.

A stream is a DataFrame, static or streaming. If it has a batch column, all its aggregates, joins and
top-n operators work batch by batch: the batch column joins every key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions import rows
from flowspark.functions.aggregates import Combiner, General, Native, Reducer
from flowspark.operators import partitioning
from flowspark.schema import distinct_fields, fresh, require

BATCH = "__batch_id"


def _rows(table) -> Iterator[dict]:
    yield from table.to_pylist()


class Stream:
    def __init__(self, df: DataFrame, batch: str | None = None, label: str = "stream"):
        distinct_fields(df.columns)
        self.df, self.label = df, label
        self.batch = batch if batch is not None else (BATCH if BATCH in df.columns else None)

    def _with(self, df: DataFrame) -> Stream:
        return Stream(df, self.batch if self.batch in df.columns else None, self.label)

    @property
    def _batch_keys(self) -> list[str]:
        return [self.batch] if self.batch else []

    @property
    def output_fields(self) -> list[str]:
        return [c for c in self.df.columns if c != self.batch]

    def to_stream(self) -> Stream:
        return self

    def name(self, label: str) -> Stream:
        return Stream(self.df, self.batch, label)

    def parallelism_hint(self, n: int) -> Stream:
        """Spread the rows evenly over ``n`` partitions."""
        return self._with(self.df.repartition(n))

    def apply_assembly(self, assembly: Callable[[Stream], Stream]) -> Stream:
        return assembly(self)

    # Rows

    def project(self, *keep: str) -> Stream:
        require(self.df, distinct_fields(keep))
        return self._with(self.df.select(*self._batch_keys, *keep))

    def each(self, value: Column, out: str | Sequence[str], flat: bool = False) -> Stream:
        """Append ``value`` as the field(s) ``out``. ``flat``: ``value`` is an array; each element makes a row, an
        empty or null array drops the row, and elements that are structs fill several fields."""
        names = fresh(self.df, [out] if isinstance(out, str) else out)
        if not flat:
            return self._with(self.df.withColumn(names[0], value))
        if len(names) == 1:
            return self._with(self.df.select("*", F.explode(value).alias(names[0])))
        wide = self.df.select("*", F.explode(value).alias("__emit"))
        fields = wide.schema["__emit"].dataType.names
        return self._with(wide.select(*self.df.columns, *[F.col("__emit")[f].alias(n) for f, n in zip(fields, names, strict=True)]))

    def each_python(self, function: Callable[..., Iterable[tuple]], inputs: Sequence[str], out: str) -> Stream:
        """Append the tuples that ``function(*inputs)`` yields for a row, one row each. ``out`` is a DDL string.
        Runs in Arrow batches; prefer ``each`` where a column expression will do."""
        require(self.df, inputs)
        added = T.StructType.fromDDL(out)
        fresh(self.df, added.names)
        schema = T.StructType([*self.df.schema.fields, *added.fields])

        def run(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            kinds = to_arrow_schema(schema)
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in inputs] or [[]] * 0
                emitted, source = [], []
                for i in range(batch.num_rows):
                    for row in function(*(c[i] for c in columns)):
                        emitted.append(row)
                        source.append(i)
                taken = batch.take(pa.array(source, pa.int64()))
                fields = list(zip(*emitted, strict=True)) if emitted else [()] * len(added)
                new = [pa.array(c, kinds.field(f.name).type) for c, f in zip(fields, added.fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*taken.columns, *new], names=schema.names)

        return self._with(self.df.mapInArrow(run, schema))

    def filter(self, condition: Column) -> Stream:
        return self._with(self.df.filter(condition))

    def filter_null(self, *fields: str) -> Stream:
        return self._with(self.df.filter(rows.not_null([F.col(f) for f in require(self.df, fields)])))

    def filter_equal(self, *fields: str) -> Stream:
        return self._with(self.df.filter(rows.all_equal([F.col(f) for f in require(self.df, fields)])))

    def filter_not(self, condition: Column) -> Stream:
        return self._with(self.df.filter(rows.negate(condition)))

    def debug(self, label: str | None = None) -> Stream:
        """Count the rows that pass, under ``label``, without changing them (see ``streaming.metrics``)."""
        return self._with(self.df.observe(label or self.label, F.count(F.lit(1)).alias("rows")))

    # Partitioning

    def shuffle(self, n: int | None = None) -> Stream:
        return self._with(partitioning.shuffle(self.df, n))

    def local_or_shuffle(self) -> Stream:
        return self

    def identity_partition(self) -> Stream:
        return self

    def partition_by(self, *fields: str, n: int | None = None) -> Stream:
        return self._with(partitioning.by_fields(self.df, require(self.df, fields), n))

    def partition(self, target: Column, n: int) -> Stream:
        """Custom grouping: ``target`` is a partition number, or an array of them (one copy each)."""
        return self._with(partitioning.custom(self.df, target, n))

    def global_partition(self) -> Stream:
        return self._with(partitioning.single(self.df))

    def batch_global(self, n: int | None = None) -> Stream:
        return self._with(partitioning.by_fields(self.df, require(self.df, self._batch_keys or self.df.columns[:1]), n)) if self.batch else self.global_partition()

    def broadcast(self, n: int) -> Stream:
        return self._with(partitioning.replicate(self.df, n))

    # Aggregation

    def group_by(self, *fields: str) -> GroupedStream:
        return GroupedStream(self, require(self.df, distinct_fields(fields)))

    def aggregate(self, aggregator: Native | Combiner | Reducer | General, out: str, batches: DataFrame | None = None, order: Sequence[str] = ()) -> Stream:
        """One answer per batch, zero for an empty one. ``batches`` lists the batches that must be answered, if the
        stream has a batch column; without it, batches without rows have no answer."""
        if isinstance(aggregator, Native):
            return self.chained_agg([(aggregator, out)], batches)
        return self._with(_python_aggregate(self.df, self._batch_keys, aggregator, out, order))

    def chained_agg(self, pairs: Sequence[tuple[Native, str]], batches: DataFrame | None = None) -> Stream:
        """Several aggregators in one pass. Answers of many rows are crossed with each other."""
        distinct_fields([*self._batch_keys, *[n for _, n in pairs]])
        df = _native(self.df, self._batch_keys, pairs)
        if self.batch and batches is not None:
            ids = batches.select(F.col(self.batch).alias("__b")).distinct()
            df = ids.join(df, ids["__b"].eqNullSafe(df[self.batch]), "left")
            df = df.select(F.col("__b").alias(self.batch), *[(F.coalesce(F.col(n), F.lit(a.zero)) if a.zero is not None else F.col(n)).alias(n) for a, n in pairs])
        return self._with(_explode_many(df, pairs))

    def partition_aggregate(self, pairs: Sequence[tuple[Native, str]], partition: Column | None = None, by: str = "partition") -> Stream:
        """Aggregate within each partition: the physical one, without a shuffle of rows, or the one that
        ``partition`` numbers."""
        df = self.df.withColumn(by, F.spark_partition_id() if partition is None else partition)
        return self._with(_explode_many(_native(df, [*self._batch_keys, by], pairs), pairs))

    # Top-n

    def first_n(self, n: int, sort: str | None = None, reverse: bool = False, ties: Sequence[str] = ()) -> Stream:
        """The first ``n`` rows of each batch: ascending by ``sort`` (descending if ``reverse``), ties by ``ties``;
        any rows if there is no ``sort``."""
        keys = require(self.df, [*([sort] if sort else []), *ties])
        order = [*([F.col(sort).desc() if reverse else F.col(sort).asc()] if sort else []), *[F.col(t).asc() for t in ties]]
        if not self.batch:
            return self._with((self.df.orderBy(*order) if keys else self.df).limit(n))
        rank = F.row_number().over(Window.partitionBy(self.batch).orderBy(*(order or [F.lit(1)])))
        return self._with(self.df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank"))

    # Sets

    def merge(self, *others: Stream, out: Sequence[str] | None = None) -> Stream:
        """Bag union by position; field names of this stream unless given."""
        df = self.df
        for other in others:
            if len(other.df.columns) != len(df.columns):
                raise ValueError(f"fields differ in number: {df.columns}, {other.df.columns}")
            df = df.union(other.df)
        return self._with(df.toDF(*self._batch_keys, *distinct_fields(out)) if out else df)


class GroupedStream:
    """A stream with group fields. The shuffle happens at the aggregate."""

    def __init__(self, stream: Stream, keys: Sequence[str]):
        self.stream, self.keys = stream, list(keys)

    @property
    def _all_keys(self) -> list[str]:
        return [*self.stream._batch_keys, *self.keys]

    def to_stream(self) -> Stream:
        return self.stream

    def name(self, label: str) -> GroupedStream:
        return GroupedStream(self.stream.name(label), self.keys)

    def each(self, value: Column, out: str | Sequence[str], flat: bool = False) -> GroupedStream:
        return GroupedStream(self.stream.each(value, out, flat), self.keys)

    def filter(self, condition: Column) -> GroupedStream:
        return GroupedStream(self.stream.filter(condition), self.keys)

    def aggregate(self, aggregator: Native | Combiner | Reducer | General, out: str, order: Sequence[str] = ()) -> Stream:
        if isinstance(aggregator, Native):
            return self.chained_agg([(aggregator, out)])
        return self.stream._with(_python_aggregate(self.stream.df, self._all_keys, aggregator, out, order))

    def chained_agg(self, pairs: Sequence[tuple[Native, str]]) -> Stream:
        distinct_fields([*self._all_keys, *[n for _, n in pairs]])
        return self.stream._with(_explode_many(_native(self.stream.df, self._all_keys, pairs), pairs))

    def partition_aggregate(self, pairs: Sequence[tuple[Native, str]], partition: Column | None = None, by: str = "partition") -> GroupedStream:
        df = self.stream.df.withColumn(by, F.spark_partition_id() if partition is None else partition)
        return GroupedStream(self.stream._with(_explode_many(_native(df, [*self._all_keys, by], pairs), pairs)), self.keys)

    def distinct(self) -> Stream:
        return self.stream._with(self.stream.df.select(*self._all_keys).distinct())


def _native(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[Native, str]]) -> DataFrame:
    return df.groupBy(*keys).agg(*[a.expr.alias(n) for a, n in pairs]) if keys else df.agg(*[a.expr.alias(n) for a, n in pairs])


def _explode_many(df: DataFrame, pairs: Sequence[tuple[Native, str]]) -> DataFrame:
    for aggregator, name in pairs:
        if aggregator.many:
            df = df.withColumn(name, F.explode(name))
    return df


def _python_aggregate(df: DataFrame, keys: Sequence[str], aggregator: Combiner | Reducer | General, out: str, order: Sequence[str]) -> DataFrame:
    """User-written aggregators. A combiner is combined per partition before the shuffle; the others see all rows
    of a group in one task, sorted by ``order``."""
    require(df, [*keys, *order])
    key_fields = [df.schema[k] for k in keys]
    grouped = list(keys) or ["__all"]
    if not keys:
        df = df.withColumn("__all", F.lit(0))
        key_fields = [T.StructField("__all", T.IntegerType())]
    if isinstance(aggregator, General):
        fields = T.StructType.fromDDL(aggregator.schema).fields
    else:
        fields = T.StructType.fromDDL(f"{out} {aggregator.type}").fields
    schema = T.StructType([*key_fields, *fields])

    def table(rows: list[tuple]):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
        return pa.Table.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(columns)], schema=kinds)

    if isinstance(aggregator, Combiner):
        def partial(batches):
            current: dict[tuple, object] = {}
            for batch in batches:
                for row in _rows(batch):
                    key, value = tuple(row[k] for k in grouped), aggregator.init(row)
                    current[key] = aggregator.combine(current[key], value) if key in current else value
                if len(current) > 100_000:
                    yield from table([(*k, v) for k, v in current.items()]).to_batches()
                    current = {}
            yield from table([(*k, v) for k, v in current.items()]).to_batches()

        def final(group):
            value, first = None, True
            for v in group.column(out).to_pylist():
                value, first = (v if first else aggregator.combine(value, v)), False
            return table([(*(group.column(k)[0].as_py() for k in grouped), value)])

        result = df.mapInArrow(partial, schema).groupBy(*grouped).applyInArrow(final, schema)
    else:
        def whole(group):
            if order:
                group = group.sort_by([(o, "ascending") for o in order])
            key = tuple(group.column(k)[0].as_py() for k in grouped)
            if isinstance(aggregator, General):
                return table([(*key, *r) for r in aggregator.run(_rows(group))])
            value = aggregator.init()
            for row in _rows(group):
                value = aggregator.reduce(value, row)
            return table([(*key, value)])

        result = df.groupBy(*grouped).applyInArrow(whole, schema)
    return result if keys else result.drop("__all")
