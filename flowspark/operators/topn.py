"""Rankings: the objects with the highest counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.schema import require


def rankings(df: DataFrame, obj: str, count: str, n: int = 10, per: Sequence[str] = ()) -> DataFrame:
    """Add ``rank`` (from 1) and keep the ``n`` highest counts, for each ``per`` if given. An object's latest count
    is expected once; zero counts are pruned; ties go to the smaller object."""
    require(df, [obj, count, *per])
    if n < 1:
        raise ValueError("n is at least 1")
    live = df.filter(F.col(count) != 0)
    order = [F.col(count).desc(), F.col(obj).asc()]
    if not per:
        # Partial top-n in each partition, then one merge of n rows a partition.
        live = live.orderBy(*order).limit(n)
        return live.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return live.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("rank") <= n)
