"""Request/response functions: a request is a row, an answer a JSON list of rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.schema import require


def requests(spark: SparkSession, args: Sequence[str]) -> DataFrame:
    """(request_id, args): one row a request."""
    return spark.createDataFrame(list(enumerate(args)), "request_id long, args string")


def answers(asked: DataFrame, rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(request_id, args, result): the ``fields`` of each request's rows as a JSON list of lists, ``[]`` for none."""
    require(rows, ["request_id", *fields])
    cells = F.array(*[F.col(f).cast("string") for f in fields])
    results = rows.groupBy("request_id").agg(F.sort_array(F.collect_list(cells)).alias("rows")).select("request_id", F.to_json("rows").alias("result"))
    return asked.join(results, "request_id", "left").withColumn("result", F.coalesce("result", F.lit("[]")))


class Functions:
    """Named request functions: ``register`` one, ``execute`` it for some arguments."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._functions: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {}

    def register(self, name: str, function: Callable[[DataFrame], DataFrame], fields: Sequence[str]) -> None:
        if name in self._functions:
            raise ValueError(f"function exists already: {name}")
        self._functions[name] = (function, list(fields))

    def run(self, name: str, asked: DataFrame) -> DataFrame:
        if name not in self._functions:
            raise ValueError(f"unknown function {name}; available: {sorted(self._functions)}")
        function, fields = self._functions[name]
        return answers(asked, function(asked), fields)

    def execute(self, name: str, args: str) -> str:
        return self.run(name, requests(self.spark, [args])).first()["result"]


def linear(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Steps, one after the other, as one request function."""
    def function(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df
    return function


def reach(asked: DataFrame, shared_by: DataFrame, followers: DataFrame, url: str, user: str, follower: str) -> DataFrame:
    """(request_id, reach): distinct followers of all who shared the request's url; 0 if it is unknown."""
    sharers = asked.join(shared_by, asked["args"].eqNullSafe(shared_by[url].cast("string"))).select("request_id", user)
    reached = sharers.join(followers, user).groupBy("request_id").agg(F.count_distinct(follower).alias("reach"))
    return asked.join(reached, "request_id", "left").select("request_id", F.coalesce("reach", F.lit(0)).alias("reach"))
