"""Joins, reducers over several streams, windows, elastic analysis and the order book."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowspark import queries
from flowspark.operators import elastic, joins, orderbook, validators, windows
from flowspark.operators.joins import INNER, OUTER, join, multi_reduce, natural_join
from flowspark.operators.stream import BATCH, Stream


def stream(spark, data, schema):
    return Stream(spark.createDataFrame(data, schema))


def got(s):
    return Counter(tuple(r) for r in (s.df if isinstance(s, Stream) else s).collect())


def test_join_types_per_side(spark):
    left, right = stream(spark, [(1, "a"), (2, "b"), (None, "n")], "k int, v string"), stream(spark, [(1, "x"), (1, "y"), (3, "z"), (None, "m")], "k int, w string")
    def run(*types):
        return got(join([(left, ["k"]), (right, ["k"])], ["key", "v", "w"], types or None))
    both = [(1, "a", "x"), (1, "a", "y"), (None, "n", "m")]
    assert run() == Counter(both)
    assert run(INNER, OUTER) == Counter([*both, (2, "b", None)])
    assert run(OUTER, INNER) == Counter([*both, (3, None, "z")])
    assert run(OUTER, OUTER) == Counter([*both, (2, "b", None), (3, None, "z")])


def test_join_of_three_with_mixed_types(spark):
    a, b, c = (stream(spark, [(k, f"{n}{k}") for k in ks], f"k int, {n} string") for n, ks in (("a", [1, 2, None]), ("b", [1, 3, None]), ("c", [1, 2, 3, 4])))
    sides = [(a, ["k"]), (b, ["k"]), (c, ["k"])]
    assert got(join(sides, ["k", "a", "b", "c"])) == Counter([(1, "a1", "b1", "c1")])
    assert got(join(sides, ["k", "a", "b", "c"], [OUTER, OUTER, INNER])) == Counter([(1, "a1", "b1", "c1"), (2, "a2", None, "c2"), (3, None, "b3", "c3"), (4, None, None, "c4")])
    assert got(join(sides, ["k", "a", "b", "c"], [INNER, OUTER, OUTER])) == Counter([(1, "a1", "b1", "c1"), (2, "a2", None, "c2"), (None, "aNone", "bNone", None)])


def test_join_checks_and_batches(spark):
    a = stream(spark, [(1, 2)], "k int, v int")
    for bad in (lambda: join([(a, ["k"])], ["k"]), lambda: join([(a, ["k"]), (a, ["k", "v"])], ["k"]), lambda: join([(a, ["k"]), (a, ["k"])], ["k", "v"]), lambda: join([(a, ["q"]), (a, ["k"])], ["k"])):
        with pytest.raises(ValueError):
            bad()
    x = Stream(spark.createDataFrame([(0, 1, "p"), (1, 1, "q")], f"{BATCH} long, k int, v string"))
    assert got(join([(x, ["k"]), (x, ["k"])], ["k", "v", "w"])) == Counter([(0, 1, "p", "p"), (1, 1, "q", "q")])


def test_natural_join(spark):
    rng = random.Random(31)
    left, right = [(rng.randrange(12), rng.choice("pq")) for _ in range(20)], [(rng.randrange(12), rng.randrange(90)) for _ in range(20)]
    a, b = stream(spark, left, "id int, kind string"), stream(spark, right, "id int, size int")
    assert got(natural_join([a, b], ["kind", "size"])) == Counter((k, n) for i, k in left for j, n in right if i == j)
    with pytest.raises(ValueError):
        natural_join([a, stream(spark, [(1,)], "z int")], ["z"])


def test_mixed_join_of_many_equals_brute_force(spark):
    rng = random.Random(32)
    data = [[(rng.choice([None, *range(5)]), i * 100 + j) for j in range(7)] for i in range(4)]
    sides = [(stream(spark, rows, f"k int, v{i} int"), ["k"]) for i, rows in enumerate(data)]
    for types in ([OUTER, INNER, OUTER, OUTER], [OUTER, OUTER, INNER, INNER], [OUTER] * 4, [INNER, OUTER, INNER, OUTER]):
        expected = Counter()
        for key in {k for rows in data for k, _ in rows}:
            found = [[v for k, v in rows if k == key] for rows in data]
            if all(f or t == OUTER for f, t in zip(found, types, strict=True)):
                expected.update((key, *vs) for vs in itertools.product(*[f or [None] for f in found]))
        assert got(join(sides, ["k", "a", "b", "c", "d"], types)) == expected, types


def test_join_of_many_to_many_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 4)
    rng = random.Random(33)
    def rows(n, *keys):
        return [(rng.choice(keys), rng.choice([None, *range(5)]), f"{i}") for i in range(n)]
    a, b, c = rows(60, 1, 2, None, 7), rows(30, 1, 2, None, 8), [(1,), (None,), (None,), (2,), (9,)]
    sides = [(stream(spark, a, "k int, u int, v string"), ["k"]), (stream(spark, [r[:2] for r in b], "q int, w int"), ["q"]), (stream(spark, c, "k int"), ["k"])]
    expected = Counter((x[0], x[1], x[2], y[1]) for x in a for y in b for z in c if x[0] == y[0] == z[0])
    assert got(join(sides, ["k", "u", "v", "w"], many=True)) == expected == got(join(sides, ["k", "u", "v", "w"]))
    assert not got(join([sides[0], (sides[1][0].filter(F.lit(False)), ["q"])], ["k", "u", "v", "w"], many=True))
    x = Stream(spark.createDataFrame([(i % 2, None, i) for i in range(20)], f"{BATCH} long, k int, v int"))
    assert got(join([(x, ["k"]), (x, ["k"])], ["k", "v", "w"], many=True)) == Counter((i % 2, None, i, j) for i in range(20) for j in range(20) if i % 2 == j % 2)
    with pytest.raises(ValueError):
        join(sides, ["k", "u", "v", "w"], [INNER, OUTER, INNER], many=True)


def test_one_key_of_many_rows_is_dealt_to_tasks(spark):
    a, b = (stream(spark, [(1, i) for i in range(n)], f"k int, {v} int") for n, v in ((3000, "v"), (1500, "w")))
    a, b = (Stream(s.df.coalesce(1)) for s in (a, b))
    def shares(df):
        counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        return sum(counts), max(counts) / sum(counts)
    total, largest = shares(join([(a, ["k"]), (b, ["k"])], ["k", "v", "w"], many=True).df)
    assert total == 3000 * 1500 and largest < 0.6


def test_three_way_query_is_dealt_to_tasks(spark):
    found = queries.join_three_way(spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in found) < 0.6 * sum(r["count"] for r in found)


def test_multi_reduce(spark):
    a, b, c = stream(spark, [(1, 2), (1, 3), (2, 5)], "k int, v int"), stream(spark, [(1, 10), (3, 1)], "q int, w int"), stream(spark, [(None, 4)], "k int, u int")
    def reduce(key, sides):
        yield sum(r["v"] for r in sides[0]), sum(r["w"] for r in sides[1]), len(sides[2])
    assert got(multi_reduce([(a, ["k"]), (b, ["q"]), (c, ["k"])], reduce, "x int, y int, z int")) == Counter([(1, 5, 10, 0), (2, 5, 0, 0), (3, 0, 1, 0), (None, 0, 0, 1)])
    assert got(multi_reduce([(a, []), (b, [])], lambda key, s: [(len(s[0]) * len(s[1]),)], "n int")) == Counter([(6,)])


@pytest.mark.parametrize("width", [1, 2, 5, 30])
def test_sliding_counts_equal_brute_force(spark, width):
    rng = random.Random(width)
    counts = [rng.choice([0, 0, rng.randrange(1, 400)]) for _ in range(20)]
    slots = spark.createDataFrame([("o", i, n) for i, n in enumerate(counts) if n], "obj string, slot long, n long")
    out = {r["slot"]: r["total"] for r in windows.sliding_counts(slots, "obj", "slot", "n", width, len(counts) - 1).collect()}
    assert [out.get(i, 0) for i in range(len(counts))] == [sum(counts[max(0, i - width + 1):i + 1]) for i in range(len(counts))]


def test_running_and_prefix_sums(spark):
    rng = random.Random(3)
    rows = [(i * 3 + rng.randrange(3), rng.randrange(4), rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, k int, v long").repartition(5)
    running = {r["seq"]: r["running"] for r in windows.global_running_count(df, "seq").collect()}
    assert [running[s] for s, _, _ in rows] == list(range(1, 501))
    latest, expected = {}, {}
    for s, k, v in rows:
        latest[k] = v
        expected[s] = sum(latest.values())
    assert {r["seq"]: r["total"] for r in windows.latest_totals(df, "k", "v", "seq").collect()} == expected
    seen, counts = Counter(), {}
    for s, k, _ in rows:
        seen[k] += 1
        counts[s] = seen[k]
    assert {r["seq"]: r["running"] for r in windows.running_count(df, "k", [F.col("seq")]).collect()} == counts
    assert windows.global_running_count(df.limit(0), "seq").count() == 0


def test_time_windows(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + timedelta(seconds=s), "a", float(s)) for s in (0, 1, 4, 8, 100)], "ts timestamp, k string, v double")
    out = {r["start"]: r["n"] for r in windows.rolling_counts(df, "ts", ["k"]).collect()}
    assert out[t0] == 4 and out[t0 - timedelta(seconds=6)] == 2 and out[t0 + timedelta(seconds=99)] == 1
    assert {r["start"] % 60: r["per_second"] for r in windows.rates(df, "ts", 60).filter("n = 4").collect()} == {0: 4 / 60}
    stats = {r["window"]: r["n"] for r in windows.windowed_stats(df, "ts", "v", ["k"], F.lit(t0 + timedelta(seconds=100)), {"short": 10, "long": 97}).collect()}
    assert stats == {"short": 1, "long": 3, "all": 5}
    assert [r["seconds"] for r in windows.actual_length(df, "k", "ts", 2).orderBy("ts").collect()] == [0, 1, 4, 7, 96]


def test_trade_statistics(spark):
    df = spark.createDataFrame([(1, i, float(10 + i), i + 1) for i in range(150)], "k int, seq int, p double, v long")
    last = windows.trade_statistics(df, "k", "p", "v", [F.col("seq")]).orderBy(F.col("seq").desc()).first()
    window = [(10.0 + i, i + 1) for i in range(50, 150)]
    volume = sum(v for _, v in window)
    mean = sum(p * v for p, v in window) / volume
    assert last["volume_total"] == volume and last["vwap"] == pytest.approx(mean) and last["variance"] == pytest.approx(sum(v * (p - mean) ** 2 for p, v in window) / volume)


def test_shards_and_loads(spark):
    df = spark.createDataFrame([(k,) for k in (0, 1, 1, 256, 257, 5)], "k long")
    loads = {r["shard"]: r["load"] for r in elastic.histogram(df.select(elastic.shard_of(F.col("k")).alias("shard")), "shard", 256).collect()}
    assert len(loads) == 256 and (loads[0], loads[1], loads[5], loads[2]) == (2, 3, 1, 0)
    routed = elastic.route(df, F.col("k"), elastic.initial_mapping(256, 2))
    histogram = elastic.histogram(routed, "route", 2)
    assert {tuple(r) for r in histogram.collect()} == {(0, 2), (1, 4)}
    assert tuple(elastic.skewness(histogram).first()) == (0.5, True) and elastic.performance(histogram).first()["factor"] == 0.75
    assert elastic.skewness(histogram.filter("load < 0")).first()["skew"] == 0.0
    assert {r[0] for r in routed.select(elastic.partial_route(F.col("route"), [1])).collect()} == {0, elastic.REMOTE}


def test_packing_and_rebalancing():
    loads = {0: 50, 1: 30, 2: 20, 3: 10, 4: 10}
    plan = elastic.pack_decreasing(loads, 2)
    assert sorted(sum(loads[s] for s in plan if plan[s] == b) for b in (0, 1)) == [60, 60]
    moves = elastic.rebalance(loads, dict.fromkeys(loads, 0), 2)
    after = dict.fromkeys(loads, 0) | {s: b for s, _, b in moves}
    used = [sum(loads[s] for s in loads if after[s] == b) for b in (0, 1)]
    assert max(used) - min(used) <= 10 and all(a != b for _, a, b in moves) and elastic.rebalance({0: 5, 1: 5}, {0: 0, 1: 1}, 2) == []
    assert elastic.predict_parallelism(100, 10, 3) == 4 and elastic.predict_parallelism(1, 10, 3) == 2 and elastic.predict_parallelism(20, 10, 3) == 3


def brute_trades(orders):
    resting, trades = [], []
    for no, direction, price, volume in orders:
        buy = direction == "B"
        while volume:
            others = [o for o in resting if o["buy"] != buy and (o["price"] <= price if buy else o["price"] >= price)]
            if not others:
                resting.append({"no": no, "buy": buy, "price": price, "volume": volume, "at": len(trades) + len(resting) * 1e-9})
                break
            best = min(others, key=lambda o: (o["price"] if buy else -o["price"], resting.index(o)))
            n = min(volume, best["volume"])
            trades.append((no, best["no"], best["price"], n) if buy else (best["no"], no, best["price"], n))
            volume -= n
            best["volume"] -= n
            if not best["volume"]:
                resting.remove(best)
    return trades


def test_order_book(spark):
    rng = random.Random(6)
    orders = [(i, rng.choice("BS"), float(rng.randint(8, 12)), rng.randint(1, 9)) for i in range(300)]
    assert list(orderbook.replay({"order_no": n, "direction": d, "price": p, "volume": v} for n, d, p, v in orders)) == brute_trades(orders)
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(n % 3, n, t0 + timedelta(seconds=n // 2), d, p, v) for n, d, p, v in orders], "sec_code long, order_no long, ts timestamp, direction string, price double, volume long")
    expected = Counter((c, *t) for c in range(3) for t in brute_trades([o for o in orders if o[0] % 3 == c]))
    assert got(orderbook.match(df.repartition(4))) == expected


def test_validators(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 7, 1), ("b", 8, 2), ("b", 10, 3)], "k string, v long, seq int")
    assert {r["k"]: r["xor"] for r in validators.xor_check(df, "k", "v").collect()}["a"] == 0
    assert [(r["k"], r["v"]) for r in validators.gaps(df, "k", "v", "seq").collect()] == [("a", 1), ("b", 10)]


def test_queries_over_whole_tables(spark, sf_dir, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    from flowspark import queries
    from flowspark.state import StateTable

    db = duckdb.connect()
    for name in ("orders", "customer", "nation", "supplier", "events"):
        db.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    rows = {name: db.execute(f"select count(*) from {name}").fetchone()[0] for name in ("orders", "customer", "events")}
    put, sizes = StateTable.put, []
    monkeypatch.setattr(StateTable, "put", lambda self, df, *a: (sizes.append(df.count()), put(self, df, *a))[1])
    found = {}
    for name in ("join_left", "join_right", "join_full", "join_mixed", "non_transactional_replay", "state_json", "map_get"):
        sizes.clear()
        df = queries.QUERIES[name](spark, sf_dir)
        found[name] = df.collect()
        assert Counter(map(tuple, found[name])) == Counter(db.execute(queries.ORACLE_SQL[name]).fetchall()), name
        assert df.columns == [c[0] for c in db.description], name
    assert sizes == [rows["customer"]]
    assert len({r.o_orderkey for r in found["join_full"]} - {None}) == rows["orders"] and len({r.c_name for r in found["join_full"]} - {None}) == rows["customer"]
    assert len({r.c_custkey for r in found["join_mixed"]}) == rows["customer"]
    assert sum(r.n for r in found["non_transactional_replay"]) == rows["events"] + db.execute("select count(*) from events where event_id % 2 = 0").fetchone()[0]
