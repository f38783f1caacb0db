"""Running streams: persistent aggregates, batch functions and finite runs for tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowspark.functions.aggregates import Combiner, Native, Reducer
from flowspark.operators.stream import Stream
from flowspark.schema import require
from flowspark.shared import fresh_path
from flowspark.state import StateTable


def for_each_batch(df: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, start: bool = True):
    """Call ``function(batch, epoch)`` in strict epoch order. It may see an epoch again after a failure: make it
    idempotent, as StateTable updates are. Without ``every``: all that is there now, then stop."""
    writer = df.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start() if start else writer


def persistent_aggregate(df: DataFrame, keys: Sequence[str], aggregator: Native | Combiner | Reducer, state: StateTable, checkpoint: str, every: str | None = None,
                         order: Sequence[str] = (), new_values: str | None = None) -> StreamingQuery:
    """Aggregate each batch by key, then merge into ``state``: one write per key and batch, exactly once for the
    transactional and opaque kinds. ``new_values``: a folder that gets each batch's new values (see ``new_values_stream``)."""
    require(df, [*keys, *order])

    def one(batch: DataFrame, epoch: int) -> None:
        touched = update_state(batch, keys, aggregator, state, epoch, order)
        if new_values:
            touched.write.mode("overwrite").parquet(f"{new_values}/epoch={epoch}")

    return for_each_batch(df, one, checkpoint, every)


def update_state(batch: DataFrame, keys: Sequence[str], aggregator: Native | Combiner | Reducer, state: StateTable, epoch: int, order: Sequence[str] = ()) -> DataFrame:
    """One batch of ``persistent_aggregate``; returns (keys, new value) of the keys touched. A native aggregator and a
    combiner aggregate the batch before they meet the state; a reducer sees the rows of a key in ``order``."""
    if isinstance(aggregator, Native):
        value = aggregator.expr.alias(state.value)
        # Without keys an empty batch would count as its zero: there is nothing to merge.
        deltas = batch.groupBy(*keys).agg(value) if keys else batch.groupBy(F.lit(0).alias("__all")).agg(value).drop("__all")
        return state.update(deltas, epoch, aggregator.merge)
    if isinstance(aggregator, Combiner):
        stream = Stream(batch)
        deltas = (stream.group_by(*keys) if keys else stream).aggregate(aggregator, state.value).df
        return state.fold(deltas, epoch, _combined(aggregator, state.value))
    return state.fold(batch, epoch, _reduced(aggregator), order)


def _combined(aggregator: Combiner, value: str) -> Callable:
    return lambda now, rows: rows[0][value] if now is None else aggregator.combine(now, rows[0][value])


def _reduced(aggregator: Reducer) -> Callable:
    def fold(now, rows: list[dict]):
        now = aggregator.init() if now is None else now
        for row in rows:
            now = aggregator.reduce(now, row)
        return now
    return fold


def new_values_stream(state: StateTable, folder: str) -> DataFrame:
    """(keys, value, epoch): what ``persistent_aggregate`` wrote to ``folder``, as a stream to chain on. A batch that
    came twice may be seen twice, with its number."""
    spark = state.spark
    fs, p = state._fs(folder)
    fs.mkdirs(p)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*state.key_schema.fields, state.value_field))
    return spark.readStream.schema(f"{schema}, epoch long").parquet(folder)


class StateUpdater:
    """User code that puts batches into a state of any kind. ``update`` may return new values."""

    def prepare(self) -> None:
        """Called once, before the first batch."""

    def update(self, state: object, batch: DataFrame, epoch: int) -> DataFrame | None:
        raise NotImplementedError

    def cleanup(self) -> None:
        """Called when the stream has ended."""


def partition_persist(df: DataFrame, make_state: Callable[[], object], updater: StateUpdater, checkpoint: str, on_new: Callable[[DataFrame, int], None] | None = None) -> object:
    """Run ``updater`` over each batch that is there now, in epoch order, against the state that ``make_state`` makes;
    what it returns goes to ``on_new``. A state may have ``begin_commit(epoch)`` and ``commit(epoch)``, called around each
    batch. Returns the state."""
    state = make_state()

    def one(batch: DataFrame, epoch: int) -> None:
        getattr(state, "begin_commit", lambda _: None)(epoch)
        out = updater.update(state, batch, epoch)
        getattr(state, "commit", lambda _: None)(epoch)
        if out is not None and on_new:
            on_new(out, epoch)

    updater.prepare()
    try:
        for_each_batch(df, one, checkpoint).awaitTermination()
    finally:
        updater.cleanup()
    return state


def rolling_top(df: DataFrame, obj: str, n: int) -> DataFrame:
    """The ``n`` most frequent objects so far; complete mode only."""
    return df.groupBy(obj).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), F.col(obj)).limit(n)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, delay: str, how: str = "inner") -> DataFrame:
    """Stream-stream join of rows with the same key (null matches null) at most ``within`` apart; rows without a
    partner are dropped from state once the watermark passes them."""
    a = left.withWatermark(left_ts, delay).alias("a")
    b = right.withWatermark(right_ts, delay).alias("b")
    on = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    near = F.expr(f"b.{right_ts} between a.{left_ts} - interval {within} and a.{left_ts} + interval {within}")
    return a.join(b, on & near, how)


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table in the shared folder, and return the table. In complete
    mode the last batch's result stands."""
    spark = df.sparkSession
    path, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "checkpoint")

    def write(batch: DataFrame, epoch: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(path)
        else:
            batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(path).select(*df.columns)  # folders are no columns
