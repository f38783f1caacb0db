"""Row functions, filters, aggregators and partitioning: literal examples and small golden results."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowspark.functions import aggregates as agg
from flowspark.functions import rows
from flowspark.operators import partitioning, topn
from flowspark.operators.stream import BATCH, Stream
from flowspark.sources import tables


def stream(spark, data, schema):
    return Stream(spark.createDataFrame(data, schema))


def got(s):
    df = s.df if isinstance(s, Stream) else s
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def abc(spark):
    return stream(spark, [(7, 3, 1), (5, 0, 2), (9, 1, 4)], "a int, b int, c int")


def test_function_appends_and_drops(abc):
    upto = F.when(F.col("b") > 0, F.sequence(F.lit(0), F.col("b") - 1))
    expected = Counter((*r, i) for r in [(7, 3, 1), (5, 0, 2), (9, 1, 4)] for i in range(r[1]))
    assert got(abc.each(upto, "d", flat=True)) == expected
    assert got(abc.each_python(lambda b: [(i,) for i in range(b)], ["b"], "d int")) == expected


def test_filters(spark, abc):
    assert got(abc.filter((F.col("b") < 2) & (F.col("a") > 5))) == Counter([(9, 1, 4)])
    s = stream(spark, [(1, 1), (1, 2), (None, None), (None, 1)], "x int, y int")
    assert got(s.filter_null("x")) == Counter([(1, 1), (1, 2)])
    assert got(s.filter_equal("x", "y")) == Counter([(1, 1), (None, None)])
    assert got(s.filter_not(F.col("x") == F.col("y"))) == Counter([(1, 2), (None, None), (None, 1)])
    assert got(s.filter(rows.always())) == got(s) and got(abc.project("c", "a")) == Counter([(1, 7), (2, 5), (4, 9)])


def test_unknown_and_duplicate_fields_raise(abc):
    for bad in (lambda: abc.project("nope"), lambda: abc.group_by("nope"), lambda: abc.filter_null("nope"), lambda: abc.partition_by("nope"), lambda: abc.each(F.lit(1), "a"),
                lambda: abc.each_python(lambda x: [], ["nope"], "d int"), lambda: abc.first_n(1, "nope"), lambda: abc.project("a", "a"), lambda: abc.merge(abc.project("a")),
                lambda: abc.chained_agg([(agg.count(), "n"), (agg.count(), "n")])):
        with pytest.raises(ValueError):
            bad()


def test_split_functions(spark):
    df = spark.createDataFrame([(" a  b ", "banana"), ("", "xyz")], "t string, w string")
    out = df.select(rows.split_words(F.col("t")), rows.split_fields(F.col("t")), rows.prefixes_before(F.col("w")), rows.exclaim(F.col("w")), rows.string_length(F.col("w"))).collect()
    assert list(out[0]) == [["a", "b"], ["", "a", "", "b"], ["b", "ban", "banan"], "banana!!!", 6]
    assert list(out[1])[:3] == [[], [""], []]
    assert spark.createDataFrame([('[["a","1"],["b"]]',)], "args string").select(F.explode(rows.parse_rows(F.col("args")))).collect()[0][0] == ["a", "1"]


def test_word_count_batches(spark):
    rng = random.Random(41)
    batches = [[(" ".join(rng.choices(["ash", "birch", "cedar", "elm"], k=rng.randrange(6))),) for _ in range(rng.randrange(1, 5))] for _ in range(3)]
    s = tables.fed_batches(spark, "line string", batches).project("line")
    counts = s.each(rows.split_words(F.col("line")), "word", flat=True).group_by("word").aggregate(agg.count(), "n")
    expected = Counter((b, w) for b, lines in enumerate(batches) for (line,) in lines for w in line.split())
    assert {(r[BATCH], r["word"]): r["n"] for r in counts.df.collect()} == dict(expected)


def test_zero_for_empty_batches_but_not_for_groups(spark):
    s = tables.in_batches(spark.createDataFrame([(1, 5), (1, 6), (3, 1)], "b int, v int"), F.col("b"))
    every = spark.range(4).select(F.col("id").alias(BATCH))
    assert {tuple(r) for r in s.chained_agg([(agg.count(), "n"), (agg.total("v"), "v")], every).df.collect()} == {(0, 0, 0), (1, 2, 11), (2, 0, 0), (3, 1, 1)}
    nothing = stream(spark, [], "v int")
    assert got(nothing.aggregate(agg.count(), "n")) == Counter([(0,)]) and got(nothing.aggregate(agg.total("v"), "s")) == Counter([(0,)])
    assert got(nothing.group_by("v").aggregate(agg.count(), "n")) == Counter()
    assert agg.one().zero == 1 and got(stream(spark, [(1,), (1,), (2,)], "v int").group_by("v").aggregate(agg.one(), "one")) == Counter([(1, 1), (2, 1)])


def test_partition_aggregate(spark):
    rng = random.Random(42)
    data = [(rng.randrange(4), rng.choice("wxyz"), rng.randrange(50)) for _ in range(30)]
    s = stream(spark, data, "p int, a string, b int")
    out = {r["p2"]: r["s"] for r in s.partition_aggregate([(agg.total("b"), "s")], F.col("p"), by="p2").df.collect()}
    assert out == {p: sum(b for q, _, b in data if q == p) for p in {p for p, _, _ in data}}
    physical = s.partition_aggregate([(agg.total("b"), "s")]).df.agg(F.sum("s")).first()[0]
    assert physical == sum(b for _, _, b in data)


def test_two_phases_merge_as_the_aggregators_do(spark):
    rng = random.Random(43)
    df = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), rng.randrange(9), "x") for _ in range(200)], "k int, v int, salt string")
    pairs = [(agg.count(), "n"), (agg.one(), "one"), (agg.total("v"), "s"), (agg.collect("v"), "all")]
    plain = df.groupBy("k").agg(*[a.expr.alias(n) for a, n in pairs])
    twice = partitioning.two_phase(df, ["k"], pairs, 5)
    assert sorted(map(str, twice.collect())) == sorted(map(str, plain.collect()))


def test_user_written_aggregators(spark):
    s = stream(spark, [("x", 1), ("x", 5), ("y", 2), (None, 7), (None, 1)], "k string, v int").shuffle(3)
    largest = agg.Combiner(lambda r: r["v"], max, lambda: 0, "int")
    assert got(s.group_by("k").aggregate(largest, "m")) == Counter([("x", 5), ("y", 2), (None, 7)])
    assert got(s.aggregate(largest, "m")) == Counter([(7,)])
    joined = agg.Reducer(lambda: "", lambda now, r: now + str(r["v"]), "string")
    assert got(s.group_by("k").aggregate(joined, "t", order=["v"])) == Counter([("x", "15"), ("y", "2"), (None, "17")])
    twice = agg.General(lambda rs: [(r["v"], i) for r in rs for i in range(2) if r["v"] > 1], "v2 int, i int")
    assert got(s.group_by("k").aggregate(twice, "")) == Counter([("x", 5, 0), ("x", 5, 1), ("y", 2, 0), ("y", 2, 1), (None, 7, 0), (None, 7, 1)])


def test_chained_answers_are_crossed(spark):
    s = stream(spark, [(1, "a"), (1, "b"), (2, "c")], "k int, v string").group_by("k")
    out = s.chained_agg([(agg.collect("v"), "v"), (agg.count(), "n"), (agg.collect("v"), "w")])
    assert got(out) == Counter([(1, v, 2, w) for v in "ab" for w in "ab"] + [(2, "c", 1, "c")])


def test_partitioning(spark):
    df = spark.range(24).select(F.col("id"), (F.col("id") % 2).alias("k"))
    assert {r[1] for r in partitioning.shuffle(df, 6).groupBy(F.spark_partition_id()).count().collect()} == {4}
    assert partitioning.by_fields(df, ["k"], 8).select("k", F.spark_partition_id()).distinct().count() == 2
    assert partitioning.replicate(df, 3).count() == 72 and partitioning.single(df).rdd.getNumPartitions() == 1
    assert partitioning.custom(df, F.array(F.lit(0), F.lit(2)), 3).count() == 48
    assert {r[0] for r in df.select(partitioning.index_hash(F.col("id"), 5)).collect()} <= set(range(5))
    skewed = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    plain = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    assert got(partitioning.two_phase(skewed, ["k"], [(agg.count(), "n"), (agg.total("id"), "s")], 4)) == got(plain)


def test_first_n_and_rankings(spark):
    s = stream(spark, [(x, c) for x, c in zip("ABCDEFGH", range(1, 9), strict=True)] + [("ZERO", 0)], "o string, n int")
    assert [r["o"] for r in s.first_n(3, "n", reverse=True).df.collect()] == ["H", "G", "F"]
    assert [r["o"] for r in s.first_n(2, "n", ties=["o"]).df.collect()] == ["ZERO", "A"] and s.first_n(4).df.count() == 4
    top = topn.rankings(s.df, "o", "n", 100).collect()
    assert [(r["rank"], r["o"]) for r in sorted(top, key=lambda r: r["rank"])] == [(i, x) for i, x in enumerate("HGFEDCBA", 1)]
    with pytest.raises(ValueError):
        topn.rankings(s.df, "o", "n", 0)


def test_merge_and_apply(spark):
    a, b = stream(spark, [("fir",), ("oak",)], "w string"), stream(spark, [("3",)], "n string")
    assert got(a.merge(b)) == Counter([("fir",), ("oak",), ("3",)]) and a.merge(b, out=["x"]).output_fields == ["x"]
    assert a.apply_assembly(lambda s: s.filter(F.col("w") == "fir")).df.count() == 1 and a.name("words").label == "words"
