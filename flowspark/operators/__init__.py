"""Stream operators over DataFrames."""

from flowspark.operators.stream import GroupedStream, Stream

__all__ = ["GroupedStream", "Stream"]
