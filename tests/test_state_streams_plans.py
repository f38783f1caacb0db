"""State tables with replays, streams against their static twins, sources, plans and the registered queries."""

import json
import os
import random
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowspark import queries
from flowspark.functions import aggregates as agg
from flowspark.functions import rows
from flowspark.operators.stream import BATCH, Stream
from flowspark.plans import builder, requests
from flowspark.sources import connectors, generators, python_source, schemes, tables
from flowspark.state import NON_TRANSACTIONAL, OPAQUE, TRANSACTIONAL, StateTable, query
from flowspark.streaming import metrics, processors, runner

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ADD = lambda a, b: a + b


def state(spark, tmp_path, kind, keys="k string", value="v long"):
    return StateTable(spark, str(tmp_path / "state"), keys, value, kind)


def deltas(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v long")


def values(table):
    return {r["k"]: r["v"] for r in table.snapshot().collect()}


def test_opaque_value_recomputes_from_before(spark, tmp_path):
    s = state(spark, tmp_path, OPAQUE)
    s.update(deltas(spark, [("x", 1), ("y", 2)]), 1, ADD)
    assert values(s) == {"x": 1, "y": 2}
    s.update(deltas(spark, [("x", 10)]), 1, ADD)
    assert values(s) == {"x": 10, "y": 2}
    touched = s.update(deltas(spark, [("x", 3), (None, 4)]), 2, ADD)
    assert values(s) == {"x": 13, "y": 2, None: 4} and {r["k"] for r in touched.collect()} == {"x", None}
    s.update(deltas(spark, [("x", 5), (None, 1)]), 2, ADD)
    assert values(s) == {"x": 15, "y": 2, None: 1}
    with pytest.raises(ValueError):
        s.update(deltas(spark, [("x", 1)]), 1, ADD)


def test_transactional_skips_repeats(spark, tmp_path):
    s = state(spark, tmp_path, TRANSACTIONAL)
    for epoch, pairs, expected in ((1, [("a", 1), ("b", 2)], {"a": 1, "b": 2}), (1, [("a", 1), ("b", 2)], {"a": 1, "b": 2}), (2, [("a", 2), ("b", 4)], {"a": 3, "b": 6})):
        s.update(deltas(spark, pairs), epoch, ADD)
        assert values(s) == expected


def test_non_transactional_and_start(spark, tmp_path):
    s = state(spark, tmp_path, NON_TRANSACTIONAL)
    s.update(deltas(spark, [("a", 1)]), 1, ADD, F.lit(100))
    s.update(deltas(spark, [("a", 1)]), 1, ADD, F.lit(100))
    assert values(s) == {"a": 102}
    with pytest.raises(ValueError):
        s.keep_newest(1)


def test_remove_is_seen_as_before_by_a_repeat(spark, tmp_path):
    s = state(spark, tmp_path, OPAQUE)
    s.put(deltas(spark, [("a", 1), ("b", 2)]), 1)
    s.remove(deltas(spark, [("a", 0)]).select("k"), 2)
    assert values(s).get("a") is None and values(s)["b"] == 2
    s.update(deltas(spark, [("a", 5)]), 2, ADD)
    assert values(s) == {"a": 6, "b": 2}
    s.remove(deltas(spark, [("a", 0)]).select("k"), 3)
    s.put(deltas(spark, [("c", 3)]), 4)
    s.remove(deltas(spark, [("zz", 0)]).select("k"), 5)
    assert values(s) == {"b": 2, "c": 3}


def test_bounded_state_json_and_versions(spark, tmp_path):
    s = state(spark, tmp_path, OPAQUE)
    for epoch in range(1, 5):
        s.put(deltas(spark, [(f"k{epoch}", epoch)]), epoch)
    s.keep_newest(2)
    assert values(s) == {"k3": 3, "k4": 4}
    assert {r["k"]: json.loads(r["json"]) for r in s.as_json().collect()} == {"k3": [3, 3, None], "k4": [4, 4, None]}
    assert sum(f.startswith("v-") for f in os.listdir(tmp_path / "state")) <= 2
    with pytest.raises(ValueError):
        StateTable(spark, "x", "k string", "v long", "other")


def test_single_value_state_and_lookups(spark, tmp_path):
    one = StateTable(spark, str(tmp_path / "one"), "", "v long")
    asks = spark.createDataFrame([("a",), ("q",), (None,)], "k string")
    assert {r["n"] for r in query.snapshot_get(asks, one.snapshot(), "v", "n").collect()} == {None}
    for epoch in (1, 2):
        one.update(spark.createDataFrame([(5,)], "v long"), epoch, ADD)
    assert {r["n"] for r in query.snapshot_get(asks, one.snapshot(), "v", "n").collect()} == {10}
    many = state(spark, tmp_path, TRANSACTIONAL)
    many.put(deltas(spark, [("a", 1), (None, 2)]), 1)
    assert {tuple(r) for r in query.map_get(asks, many.snapshot(), [("k", "k")], "v", "n").collect()} == {("a", 1), ("q", None), (None, 2)}
    assert query.collection_get(asks.withColumnRenamed("k", "ask"), many.snapshot()).count() == 6
    assert connectors.store_lookup(asks, many, [("k", "k")], "n").count() == 3


def test_partitioned_batches(spark):
    rng = random.Random(51)
    parts = {p: [(rng.choice("kmn"), rng.randrange(20)) for _ in range(rng.randrange(1, 8))] for p in range(4)}
    s = tables.partitioned_batches(spark, "word string, amount int", parts, 3)
    expected, sizes = Counter(), Counter()
    for part in parts.values():
        for i, (w, n) in enumerate(part):
            expected[i // 3, w] += n
            sizes[i // 3] += 1
    assert {(r[BATCH], r["word"]): r["s"] for r in s.group_by("word").aggregate(agg.total("amount"), "s").df.collect()} == dict(expected)
    assert {r[BATCH]: r["n"] for r in s.aggregate(agg.count(), "n").df.collect()} == dict(sizes)


def test_a_crash_at_any_step_leaves_the_state_before(spark, tmp_path, monkeypatch):
    s = state(spark, tmp_path, OPAQUE)
    s.update(deltas(spark, [("x", 1)]), 1, ADD)

    def crash(*_):
        raise RuntimeError("crash")

    for step in ("_segment", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(StateTable, step, crash)
            with pytest.raises(RuntimeError):
                s.update(deltas(spark, [("x", 5)]), 2, ADD)
        assert values(s) == {"x": 1}
    with monkeypatch.context() as m:
        m.setattr(StateTable, "_clean", crash)  # the new version is there already
        with pytest.raises(RuntimeError):
            s.update(deltas(spark, [("x", 5)]), 2, ADD)
    assert values(s) == {"x": 6}
    s.update(deltas(spark, [("x", 7)]), 2, ADD)  # the batch comes again
    assert values(s) == {"x": 8}


def test_updates_write_what_they_touch_and_merge_segments(spark, tmp_path):
    s = state(spark, tmp_path, TRANSACTIONAL)
    s.put(spark.range(3000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")), 0)
    expected = {str(i): i for i in range(3000)}
    for epoch in range(1, 20):
        s.update(deltas(spark, [(str(epoch % 5), 1), (f"new{epoch}", epoch)]), epoch, ADD)
        expected[str(epoch % 5)] += 1
        expected[f"new{epoch}"] = epoch
        segments = s._current()[1]["segments"]
        assert len(segments) <= 14
        if segments[-1][1] == 0:
            assert spark.read.parquet(f"{s.path}/{segments[-1][0]}").count() == 2
    assert values(s) == expected
    assert {(r.k, r.v) for r in s.get(spark.createDataFrame([("new3",), ("none",)], "k string")).collect()} == {("new3", 3)}
    folders = [f for f in os.listdir(tmp_path / "state") if f.startswith("s-")]
    assert len(folders) <= 16 and not [f for f in os.listdir(tmp_path / "state") if f.startswith(".staged")]


def test_reducers_and_combiners_in_state(spark, tmp_path):
    rng = random.Random(52)
    batches = [[(rng.choice(["a", "b", None]), rng.randrange(100), i) for i in range(12)] for _ in range(3)]
    joined = agg.Reducer(lambda: "", lambda now, r: f"{now}{r['x']};", "string")
    for kind in (NON_TRANSACTIONAL, TRANSACTIONAL, OPAQUE):
        s = StateTable(spark, str(tmp_path / kind), "k string", "v string", kind)
        expected, before = {}, {}
        for epoch, rows_ in enumerate(batches):
            for attempt in range(2):
                used = rows_ if attempt == 0 or kind != OPAQUE else rows_[:5]
                touched = runner.update_state(spark.createDataFrame(used, "k string, x int, i int").repartition(3), ["k"], joined, s, epoch, order=["i"])
                if kind == OPAQUE and attempt == 1:
                    expected = {k: v for k, v in before.items()} | {k: v for k, v in expected.items() if k not in {r[0] for r in used}}
                if attempt == 0:
                    before = dict(expected)
                if attempt == 0 or kind != TRANSACTIONAL:
                    for k, x, _ in used:
                        expected[k] = expected.get(k, "") + f"{x};"
                assert {r.k for r in touched.collect()} == {r[0] for r in used}
        assert values(s) == expected, kind
    one = StateTable(spark, str(tmp_path / "one"), "", "v long", OPAQUE)
    least = agg.Combiner(lambda r: r["x"], min, lambda: 0, "long")
    for epoch, rows_ in enumerate(batches):
        runner.update_state(spark.createDataFrame(rows_, "k string, x int, i int"), [], least, one, epoch)
    assert one.snapshot().first()["v"] == min(x for b in batches for _, x, _ in b)


class KeepLargest(runner.StateUpdater):
    """A state of the user's own kind: a dict."""

    def __init__(self):
        self.calls = []

    def prepare(self):
        self.calls.append("prepare")

    def update(self, state, batch, epoch):
        rows_ = batch.groupBy("word").agg(F.max("n").alias("n")).collect()
        state.update({r["word"]: max(r["n"], state.get(r["word"], 0)) for r in rows_})
        return batch.sparkSession.createDataFrame([(k, v) for k, v in state.items()], "word string, n int")

    def cleanup(self):
        self.calls.append("cleanup")


def test_updaters_and_new_values(spark, tmp_path):
    path = write_parts(spark, tmp_path, [[("oak", 1), ("elm", 5)], [("oak", 3), ("fir", 2), ("oak", 2)]], "word string, n int")
    updater, seen = KeepLargest(), []
    made = runner.partition_persist(tables.file_stream(spark, path, "word string, n int"), dict, updater, str(tmp_path / "cp1"), lambda df, epoch: seen.append((epoch, df.count())))
    assert made == {"oak": 3, "elm": 5, "fir": 2} and updater.calls == ["prepare", "cleanup"] and seen == [(0, 2), (1, 3)]
    s, folder = StateTable(spark, str(tmp_path / "sums"), "word string", "total long", TRANSACTIONAL), str(tmp_path / "new")
    chained = runner.new_values_stream(s, folder)
    runner.persistent_aggregate(tables.file_stream(spark, path, "word string, n int"), ["word"], agg.total("n"), s, str(tmp_path / "cp2"), new_values=folder).awaitTermination()
    out = runner.drain(chained.filter("total > 1"))
    assert {tuple(r) for r in out.collect()} == {("elm", 5, 0), ("oak", 6, 1), ("fir", 2, 1)}


def write_parts(spark, tmp_path, parts, schema):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_persistent_aggregate_stream(spark, tmp_path):
    rng = random.Random(53)
    lines = [" ".join(rng.choices(["ash", "birch", "cedar", "elm"], k=rng.randrange(1, 6))) for _ in range(5)]
    path = write_parts(spark, tmp_path, [[(x,) for x in lines[:2]], [(x,) for x in lines[2:]]], "line string")
    words = Stream(tables.file_stream(spark, path, "line string")).each(rows.split_words(F.col("line")), "word", flat=True).df
    s = StateTable(spark, str(tmp_path / "counts"), "word string", "n long", TRANSACTIONAL)
    runner.persistent_aggregate(words, ["word"], agg.count(), s, str(tmp_path / "cp")).awaitTermination()
    expected = Counter(w for x in lines for w in x.split())
    assert {r["word"]: r["n"] for r in s.snapshot().collect()} == dict(expected)
    functions = requests.Functions(spark)
    def total(df):
        found = query.map_get(Stream(df).each(rows.split_words(F.col("args")), "word", flat=True).df, s.snapshot(), [("word", "word")], "n", "n")
        return found.groupBy("request_id").agg(F.sum("n").alias("n"))
    functions.register("words", total, ["n"])
    assert functions.execute("words", "elm pine ash") == f'[["{expected["elm"] + expected["ash"]}"]]' and functions.execute("words", "") == "[]"
    with pytest.raises(ValueError):
        functions.execute("nope", "")


def test_running_count_and_expiry_streams(spark, tmp_path):
    processors.use_rocksdb(spark)
    path = write_parts(spark, tmp_path, [[("k1",), ("k2",)], [("k3",), ("k1",)]], "w string")
    out = runner.drain(processors.running_count_stream(tables.file_stream(spark, path, "w string"), "w"))
    assert Counter((r["key"], r["running"]) for r in out.collect()) == Counter([("k1", 1), ("k1", 2), ("k2", 1), ("k3", 1)])
    known: list = []
    df = processors.expiring_keys(tables.file_stream(spark, path, "w string"), "w", 600_000)
    q = runner.for_each_batch(df, lambda batch, epoch: known.extend(batch.collect()), queries.fresh_path(spark, "cp"), every="0 seconds")
    for _ in range(200):  # with timers there is always a next batch, so the query is stopped from here
        if len(known) >= 4 or q.awaitTermination(0.3):
            break
    q.stop()
    assert Counter((r["key"], r["known"]) for r in known) == Counter([("k1", False), ("k1", True), ("k2", False), ("k3", False)])


def test_python_source(spark):
    spark.dataSource.register(python_source.CounterSource)
    assert spark.read.format("counter").options(rows=50, keys=5).load().groupBy("key").count().filter("count = 10").count() == 5
    stream = spark.readStream.format("counter").options(rows=20, perBatch=20, keys=4).load()
    seen = []
    q = runner.for_each_batch(stream, lambda df, epoch: seen.append((epoch, df.count())), queries.fresh_path(spark, "cp"), every="0 seconds")
    for _ in range(200):
        if sum(n for _, n in seen) >= 20 or q.awaitTermination(0.3):
            break
    q.stop()
    assert sum(n for _, n in seen) == 20


def test_metrics(spark):
    listener = metrics.Progress()
    spark.streams.addListener(listener)
    try:
        df = metrics.counters(spark.readStream.format("rate").option("rowsPerSecond", 50).load(), "seen", {"even": F.col("value") % 2 == 0})
        q = df.writeStream.format("noop").option("checkpointLocation", queries.fresh_path(spark, "cp")).start()
        for _ in range(100):
            if any(b["rows"] for b in listener.batches):
                break
            q.awaitTermination(0.3)
        q.stop()
        assert any(b["observed"].get("seen", {}).get("even") for b in listener.read()) and listener.batches == []
    finally:
        spark.streams.removeListener(listener)


def test_schemes_generators_and_files(spark, tmp_path):
    raw = spark.createDataFrame([(bytearray(b'{"a": 1}'),), (bytearray(b"oops"),)], "value binary")
    assert {r["a"] for r in schemes.json(raw, "a int").collect()} == {1, None} and {r["str"] for r in schemes.text(raw).collect()} == {'{"a": 1}', "oops"}
    assert schemes.delimited(spark.createDataFrame([(bytearray(b"1;x"),)], "value binary"), "a int, b string", sep=";").first()["b"] == "x" and schemes.raw(raw).columns == ["bytes"]
    z = {r["key"]: r["count"] for r in generators.zipf(spark, 20_000, 50, 1.2).groupBy("key").count().collect()}
    assert z[0] > 4 * z.get(9, 1) and max(z) < 50
    assert generators.choices(spark.range(300), ["a", "b", "c"]).select("word").distinct().count() == 3
    connectors.delimited_sink(spark.range(25).repartition(1), str(tmp_path / "out"), "|", max_rows=10)
    assert sum(f.endswith(".csv") for f in os.listdir(tmp_path / "out")) == 3
    (tmp_path / "orders.txt").write_text("1|a|7|10.5|100|20240102|09:30:00|123|S\n2|b|7|10.0|50|20240102|09:30:01|000|B\n")
    buys, sells = tables.orders_csv(spark, str(tmp_path / "orders.txt"))
    assert (buys.count(), sells.count(), sells.first()["ts"].microsecond) == (1, 1, 123000)
    assert tables.static_state(spark, "k int", [(1,)]).count() == 1 and tables.fixed_batches(spark, "v int", 2, [(1,), (2,), (3,)], 2).df.select(BATCH).distinct().count() == 4


def test_plans(spark):
    docs = Stream(spark.createDataFrame([("a b",), ("b",)], "t string"))
    spec = {"include": [{"steps": [{"name": "words", "from": "docs", "op": "each", "value": "split(t, '${sep}')", "out": "w", "flat": True}]}],
            "steps": [{"name": "counts", "from": "words", "op": "group_count", "by": ["w"], "out": "n"}, {"name": "top", "from": "counts", "op": "first_n", "n": 1, "sort": "n", "reverse": True}]}
    assert [tuple(r) for r in builder.from_spec(spec, {"docs": docs}, {"sep": " "})["top"].df.collect()] == [("b", 2)]
    with pytest.raises(ValueError):
        builder.Pipeline().source("a", docs).step("b", lambda s: s, "nope")
    with pytest.raises(ValueError):
        builder.from_spec({"steps": [{"name": "x", "from": "docs", "op": "nope"}]}, {"docs": docs})
    order = []
    builder.in_commit_order(spark.createDataFrame([(2, "b"), (1, "a"), (2, "c")], "b long, v string"), "b", lambda df, epoch: order.append((epoch, df.count())))
    assert order == [(1, 1), (2, 2)]


def normal(rows_, names):
    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows_)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    import duckdb

    df = queries.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in queries.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in os.listdir(sf_dir):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf_dir}/{file}'")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert normal(got, df.columns) == normal(result.fetchall(), names)


def test_entry_without_the_corpus_package(tmp_path):
    code = ("import sys; sys.path.insert(0, sys.argv[1])\n"
            "import importlib.abc\n"
            "class Hide(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline', 'flowspark.llm'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Hide())\n"
            "import __spark_entry__ as e\n"
            "assert e.queries() and not any(k[:2] == 'op' and k[2:3].isdigit() or k == 'pipeline' for k in e.queries())\n"
            "assert set(e.oracle_sql()) <= set(e.queries())\n")
    subprocess.run([sys.executable, "-c", code, ROOT], check=True, timeout=120)
