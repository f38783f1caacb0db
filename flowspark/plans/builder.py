"""Pipelines as named steps. A step is a function of the streams it names as inputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from string import Template
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.stream import Stream
from flowspark.schema import require


class Pipeline:
    def __init__(self):
        self._steps: dict[str, tuple[Callable[..., Stream], tuple[str, ...]]] = {}

    def source(self, name: str, stream: Stream | DataFrame) -> Pipeline:
        made = stream if isinstance(stream, Stream) else Stream(stream)
        return self.step(name, lambda: made)

    def step(self, name: str, function: Callable[..., Stream], *inputs: str) -> Pipeline:
        """Add a step; names its inputs, which must exist. Several inputs of equal fields may be united first."""
        if name in self._steps:
            raise ValueError(f"step exists already: {name}")
        missing = [i for i in inputs if i not in self._steps]
        if missing:
            raise ValueError(f"unknown inputs {missing} of {name}; available: {sorted(self._steps)}")
        self._steps[name] = (function, inputs)
        return self

    def build(self) -> dict[str, Stream]:
        built: dict[str, Stream] = {}
        for name, (function, inputs) in self._steps.items():
            built[name] = function(*(built[i] for i in inputs)).name(name)
        return built


def from_spec(spec: Mapping[str, Any], sources: Mapping[str, Stream], values: Mapping[str, str] | None = None) -> dict[str, Stream]:
    """A pipeline from plain data (such as a parsed YAML file): ``{"steps": [{"name", "from", "op", ...}]}``.

    Ops: project (fields), filter (condition), each (value, out, flat), group_count (by, out), group_sum (by, field,
    out), first_n (n, sort, reverse), merge, shuffle (n). Expressions are SQL text. ``${name}`` is replaced from
    ``values``. ``include``: a list of further specs, taken first.
    """
    from flowspark.functions.aggregates import count, total

    def fill(x):
        if isinstance(x, str):
            return Template(x).substitute(values or {})
        if isinstance(x, Mapping):
            return {k: fill(v) for k, v in x.items()}
        return [fill(v) for v in x] if isinstance(x, Sequence) else x

    ops: dict[str, Callable[[dict, list[Stream]], Stream]] = {
        "project": lambda s, i: i[0].project(*s["fields"]),
        "filter": lambda s, i: i[0].filter(F.expr(s["condition"])),
        "each": lambda s, i: i[0].each(F.expr(s["value"]), s["out"], bool(s.get("flat"))),
        "group_count": lambda s, i: i[0].group_by(*s["by"]).aggregate(count(), s["out"]),
        "group_sum": lambda s, i: i[0].group_by(*s["by"]).aggregate(total(s["field"]), s["out"]),
        "first_n": lambda s, i: i[0].first_n(int(s["n"]), s.get("sort"), bool(s.get("reverse")), s.get("ties", ())),
        "merge": lambda s, i: i[0].merge(*i[1:]),
        "shuffle": lambda s, i: i[0].shuffle(int(s["n"]) if "n" in s else None),
    }
    pipeline = Pipeline()
    for name, stream in sources.items():
        pipeline.source(name, stream)

    def add(part: Mapping[str, Any]) -> None:
        for other in part.get("include", ()):
            add(other)
        for raw in part.get("steps", ()):
            step = fill(raw)
            if step["op"] not in ops:
                raise ValueError(f"unknown op: {step['op']}")
            inputs = [step["from"]] if isinstance(step["from"], str) else step["from"]
            pipeline.step(step["name"], lambda *streams, s=step: ops[s["op"]](s, list(streams)), *inputs)

    add(spec)
    return pipeline.build()


def in_commit_order(table: DataFrame, batch: str, function: Callable[[DataFrame, int], None]) -> None:
    """Call ``function`` for each batch of a static table, in order: the static form of ``for_each_batch``. One
    job per batch; the batch numbers are what is collected."""
    require(table, [batch])
    for row in table.select(batch).distinct().orderBy(batch).toLocalIterator():
        function(table.filter(F.col(batch) == row[0]).drop(batch), row[0])
