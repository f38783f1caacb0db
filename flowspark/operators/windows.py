"""Windows over time slots, event time and counts. Time is event time, so results are deterministic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.schema import require
from flowspark.shared import free_name, written


def slot_counts(df: DataFrame, obj: str, slot: str) -> DataFrame:
    """(obj, slot, n): how often each object occurs in each slot."""
    require(df, [obj, slot])
    return df.groupBy(obj, slot).agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(slots: DataFrame, obj: str, slot: str, n: str, width: int, last: int | None = None) -> DataFrame:
    """(obj, slot, total): each object's sum over the last ``width`` slots, at every slot at which it isn't zero.

    A quiet object still reports its decaying total, so each count is carried to the slots it reaches (at most
    ``width`` rows) and these are summed: one partial aggregation, no window over an object's whole history.
    ``last``: the last slot to report.
    """
    if width < 1:
        raise ValueError("width is at least 1")
    reach = slots.select(obj, F.explode(F.sequence(F.col(slot), F.col(slot) + (width - 1))).alias(slot), n)
    if last is not None:
        reach = reach.filter(F.col(slot) <= last)
    return reach.groupBy(obj, slot).agg(F.sum(n).alias("total"))


def rolling_counts(df: DataFrame, ts: str, keys: Sequence[str], length: str = "9 seconds", every: str = "3 seconds") -> DataFrame:
    """(keys, start, end, n) over sliding event-time windows; works on streams with a watermark too."""
    require(df, [ts, *keys])
    window = F.window(F.col(ts).cast("timestamp"), length, every)
    return df.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def over_last_rows(keys: Sequence[str], order: Sequence[Column], rows: int) -> Window:
    """A window of a key's last ``rows`` rows, the current one included."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)


def trade_statistics(df: DataFrame, key: str, price: str, volume: str, order: Sequence[Column], rows: int = 100) -> DataFrame:
    """Add volume-weighted mean price, total volume and volume-weighted variance over a key's last ``rows`` trades."""
    w = over_last_rows([key], order, rows)
    p, v = F.col(price), F.col(volume)
    mean, total = F.sum(p * v).over(w) / F.sum(v).over(w), F.sum(v).over(w)
    df = df.withColumn("vwap", mean).withColumn("volume_total", total)
    return df.withColumn("variance", F.sum(p * p * v).over(w) / F.col("volume_total") - F.col("vwap") * F.col("vwap"))


def actual_length(df: DataFrame, key: str, ts: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``seconds`` between a row and the ``n``-th before it (or the first), per key; rows of equal time by ``ties``."""
    first = F.first(ts).over(Window.partitionBy(key).orderBy(ts, *ties).rowsBetween(-n, 0))
    return df.withColumn("seconds", F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(first.cast("timestamp")))


def rates(df: DataFrame, ts: str, seconds: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, start, n, per_second) over fixed windows of ``seconds``."""
    start = (F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds).cast("long")
    out = df.groupBy(*keys, start.alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("per_second", F.col("n") / seconds)


def windowed_stats(df: DataFrame, ts: str, value: str, keys: Sequence[str], now: Column, lengths: dict[str, int]) -> DataFrame:
    """(keys, window, n, mean): counts and means over the last so many seconds before ``now`` for each name in
    ``lengths``, and over all time, in one pass."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp"))
    inside = F.filter(F.array(*[F.when((age >= 0) & (age < s), F.lit(w)) for w, s in lengths.items()], F.lit("all")), lambda w: w.isNotNull())
    return df.select(*keys, F.explode(inside).alias("window"), value).groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def running_count(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Add ``running``: how often the key has occurred up to this row."""
    return df.withColumn("running", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def global_running_count(df: DataFrame, order: str) -> DataFrame:
    """Add ``running``: the row's number in the order of the column ``order`` (unique)."""
    one = free_name(df, "one")
    return prefix_sums(df.withColumn(one, F.lit(1)), order, one, "running").drop(one)


def latest_totals(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(order, total): after each row, the sum over all keys of each key's latest value. A row adds the change of
    its key; the changes are then summed in order, range by range."""
    change = F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy(order)), F.lit(0))
    return prefix_sums(df.select(order, change.alias("__change")), order, "__change", "total").select(order, "total")


def prefix_sums(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to this row in the order of the column ``order`` (unique).

    Rows go to sampled ranges of about equal numbers, as many as the session has shuffle partitions; only the ranges'
    sums meet in one task."""
    bucket, before, end = (free_name(df, n) for n in ("bucket", "before", "end"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, order).withColumn(bucket, F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(bucket).agg(F.sum(value).alias(end))  # a row a range
    earlier = F.coalesce(F.sum(end).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = ranged.join(F.broadcast(sums.select(bucket, earlier.alias(before))), bucket)
    running = F.sum(value).over(Window.partitionBy(bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn(out, F.col(before) + running).select(*df.columns, out)
