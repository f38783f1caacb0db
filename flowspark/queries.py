"""Registered queries: one or more for each operator, over whole tables, with SQL for the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions import aggregates as agg
from flowspark.functions import rows
from flowspark.operators import elastic, orderbook, partitioning, topn, validators, windows
from flowspark.operators.joins import INNER, OUTER, join, multi_reduce, natural_join
from flowspark.operators.stream import BATCH, Stream
from flowspark.plans import builder, requests
from flowspark.shared import fresh_path
from flowspark.sources import generators, schemes, tables
from flowspark.state import NON_TRANSACTIONAL, OPAQUE, TRANSACTIONAL, StateTable, query
from flowspark.streaming import processors, runner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function
    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> Stream:
    return Stream(tables.table(spark, sf_dir, name))


# Rows

WORDS = "select unnest(string_split(text, ' ')) word, doc_id, lang from documents"


@registered(f"select word, count(*) n from ({WORDS}) where word <> '' group by word")
def word_count(spark, d):
    return read(spark, d, "documents").project("text").each(rows.split_words(F.col("text")), "word", flat=True).group_by("word").aggregate(agg.count(), "n").df


@registered("select doc_id, len(string_split(rtrim(text, ' '), ' ')) n from documents")
def split_fields(spark, d):
    return read(spark, d, "documents").each(F.size(rows.split_fields(F.col("text"))).cast("long"), "n").project("doc_id", "n").df


@registered("select o_custkey, o_orderkey, o_totalprice from orders")
def project(spark, d):
    return read(spark, d, "orders").project("o_custkey", "o_orderkey", "o_totalprice").df


@registered("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey where o_orderkey is not null")
def filter_null(spark, d):
    customers, orders = read(spark, d, "customer").project("c_custkey"), read(spark, d, "orders").project("o_custkey", "o_orderkey")
    return join([(customers, ["c_custkey"]), (orders, ["o_custkey"])], ["c_custkey", "o_orderkey"], [INNER, OUTER]).filter_null("o_orderkey").df


@registered("select l_orderkey, l_linenumber, l_quantity from lineitem where l_linenumber = l_quantity")
def equals_filter(spark, d):
    return read(spark, d, "lineitem").project("l_orderkey", "l_linenumber", "l_quantity").filter_equal("l_linenumber", "l_quantity").df


@registered("select l_orderkey, l_linenumber from lineitem where not coalesce(l_discount > 0.05, false)")
def negate_filter(spark, d):
    return read(spark, d, "lineitem").filter_not(F.col("l_discount") > 0.05).project("l_orderkey", "l_linenumber").df


@registered("select p_partkey, p_size, unnest(range(p_size))::int i from part")
def each_flatmap(spark, d):
    upto = F.when(F.col("p_size") > 0, F.sequence(F.lit(0), F.col("p_size") - 1))
    return read(spark, d, "part").project("p_partkey", "p_size").each(upto, "i", flat=True).df


@registered("select p_partkey, p_size, unnest(range(p_size % 3))::int i, 'x' tag from part")
def each_python(spark, d):
    return read(spark, d, "part").project("p_partkey", "p_size").each_python(lambda n: ((i, "x") for i in range(n % 3)), ["p_size"], "i int, tag string").df


@registered("select p_partkey, length(p_name) n, p_name || '!!!' loud from part")
def word_functions(spark, d):
    s = read(spark, d, "part")
    return s.each(rows.string_length(F.col("p_name")).cast("long"), "n").each(rows.exclaim(F.col("p_name")), "loud").project("p_partkey", "n", "loud").df


@registered("""select n_name, n_name[1:i - 1] prefix from (select n_name, unnest(range(1, length(n_name) + 1)) i from nation) where lower(n_name[i]) = 'a'""")
def prefixes(spark, d):
    nations = read(spark, d, "nation").project("n_name")
    found = F.filter(F.sequence(F.lit(1), F.length("n_name")), lambda i: F.lower(F.substr("n_name", i, F.lit(1))) == "a")
    return nations.each(F.transform(found, lambda i: F.substr(F.col("n_name"), F.lit(1), i - 1)), "prefix", flat=True).df


@registered("select n_nationkey, unnest([n_name, n_regionkey::varchar]) item from nation")
def parse_rows(spark, d):
    args = F.to_json(F.array(F.array("n_name"), F.array(F.col("n_regionkey").cast("string"))))
    s = read(spark, d, "nation").each(args, "args").each(rows.parse_rows(F.col("args")), "row", flat=True)
    return s.each(F.col("row")[0], "item").project("n_nationkey", "item").df


@registered("select label, count(*) n, round(sum(x), 3) total from (select label, unnest(embedding)::double x from embeddings) group by label")
def expand_list(spark, d):
    s = read(spark, d, "embeddings").project("label", "embedding").each(F.transform("embedding", lambda x: x.cast("double")), "x", flat=True)
    return s.group_by("label").chained_agg([(agg.count(), "n"), (agg.Native(F.round(F.sum("x"), 3), 0.0, lambda a, b: a + b), "total")]).df


@registered("select event_id, user_id, event_type from events where value > 10 and event_type <> 'click'")
def assembly(spark, d):
    def busy(s: Stream) -> Stream:
        return s.filter(F.col("value") > 10).filter(F.col("event_type") != "click")
    return read(spark, d, "events").apply_assembly(busy).project("event_id", "user_id", "event_type").df


# Aggregation

@registered("select count(*) n from lineitem where l_quantity > 1000000")
def count_global(spark, d):
    return read(spark, d, "lineitem").filter(F.col("l_quantity") > 1000000).aggregate(agg.count(), "n").df


@registered("select l_returnflag, l_linestatus, sum(l_linenumber)::bigint total from lineitem group by all")
def sum_grouped(spark, d):
    return read(spark, d, "lineitem").group_by("l_returnflag", "l_linestatus").aggregate(agg.total(F.col("l_linenumber").cast("long")), "total").df


@registered("select distinct user_id, 1 one from events")
def one_distinct(spark, d):
    return read(spark, d, "events").group_by("user_id").aggregate(agg.one(), "one").df


@registered("select l_shipmode_proxy, count(*) n, sum(l_linenumber)::bigint lines, round(sum(l_extendedprice), 2) price from (select l_returnflag || l_linestatus l_shipmode_proxy, * from lineitem) group by 1")
def chained_agg(spark, d):
    s = read(spark, d, "lineitem").each(F.concat("l_returnflag", "l_linestatus"), "l_shipmode_proxy").group_by("l_shipmode_proxy")
    price = agg.Native(F.round(F.sum("l_extendedprice"), 2), 0.0, lambda a, b: a + b)
    return s.chained_agg([(agg.count(), "n"), (agg.total(F.col("l_linenumber").cast("long")), "lines"), (price, "price")]).df


@registered("select n_regionkey, n_name, c.n_nationkey other, t.total from nation join (select n_regionkey r, sum(n_nationkey)::bigint total from nation group by 1) t on n_regionkey = r join (select n_regionkey q, n_nationkey from nation) c on q = n_regionkey")
def chained_cross(spark, d):
    s = read(spark, d, "nation").group_by("n_regionkey")
    return s.chained_agg([(agg.collect("n_name"), "n_name"), (agg.collect("n_nationkey"), "other"), (agg.total(F.col("n_nationkey").cast("long")), "total")]).df


@registered("select l_orderkey // 1000 __batch_id, count(*) n from lineitem group by 1")
def per_batch_count(spark, d):
    df = tables.table(spark, d, "lineitem")
    return tables.in_batches(df, F.floor(F.col("l_orderkey") / 1000)).aggregate(agg.count(), "n").df


@registered("select b::bigint __batch_id, coalesce(n, 0) n, coalesce(total, 0)::bigint total from range(40) t(b) left join (select user_id % 20 b, count(*) n, sum(event_id) total from events group by 1) using (b)")
def per_batch_zero(spark, d):
    s = tables.in_batches(tables.table(spark, d, "events"), F.col("user_id") % 20)
    return s.chained_agg([(agg.count(), "n"), (agg.total("event_id"), "total")], spark.range(40).select(F.col("id").alias(BATCH))).df


@registered("select l_returnflag, max(l_linenumber * 2) largest from lineitem group by 1")
def python_combiner(spark, d):
    largest = agg.Combiner(lambda r: r["l_linenumber"] * 2, max, lambda: 0, "int")
    return read(spark, d, "lineitem").project("l_returnflag", "l_linenumber").group_by("l_returnflag").aggregate(largest, "largest").df


@registered("select o_custkey, string_agg(o_orderstatus, '' order by o_orderkey) path from orders group by 1")
def python_reducer(spark, d):
    path = agg.Reducer(lambda: "", lambda now, r: now + r["o_orderstatus"], "string")
    return read(spark, d, "orders").project("o_custkey", "o_orderkey", "o_orderstatus").group_by("o_custkey").aggregate(path, "path", order=["o_orderkey"]).df


@registered("select n_regionkey, n_nationkey, (row_number() over (partition by n_regionkey order by n_nationkey))::int place from nation")
def general_aggregator(spark, d):
    numbered = agg.General(lambda rs: ((r["n_nationkey"], i) for i, r in enumerate(rs, 1)), "n_nationkey int, place int")
    return read(spark, d, "nation").project("n_regionkey", "n_nationkey").group_by("n_regionkey").aggregate(numbered, "", order=["n_nationkey"]).df


@registered("select l_orderkey % 7 as part, count(*) n, sum(l_linenumber)::bigint total from lineitem group by 1")
def partition_aggregate(spark, d):
    s = read(spark, d, "lineitem").project("l_orderkey", "l_linenumber")
    return s.partition_aggregate([(agg.count(), "n"), (agg.total(F.col("l_linenumber").cast("long")), "total")], F.col("l_orderkey") % 7, by="part").df


@registered("select user_id, count(*) n, sum(event_id)::bigint total from events group by 1")
def partial_key_agg(spark, d):
    df = tables.table(spark, d, "events").select("user_id", "event_id")
    return partitioning.two_phase(df, ["user_id"], [(agg.count(), "n"), (agg.total("event_id"), "total")])


@registered("select o_orderkey % 50 __batch_id, o_orderstatus, count(*) n, sum(o_custkey)::bigint total from orders group by 1, 2")
def batch_keyed_sums(spark, d):
    s = tables.in_batches(tables.table(spark, d, "orders"), F.col("o_orderkey") % 50).group_by("o_orderstatus")
    return s.chained_agg([(agg.count(), "n"), (agg.total("o_custkey"), "total")]).df


@registered("select o_orderkey % 50 __batch_id, string_agg(o_orderkey::varchar, ',' order by o_orderkey) numbers from orders group by 1")
def batch_lists(spark, d):
    s = tables.in_batches(tables.table(spark, d, "orders"), F.col("o_orderkey") % 50)
    numbers = agg.Native(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string"))), "", lambda a, b: F.concat_ws(",", a, b))
    return s.aggregate(numbers, "numbers").df


@registered("select n // 10 bucket, count(*) keys from (select user_id, count(*) n from events group by 1) group by 1")
def count_histogram(spark, d):
    counts = read(spark, d, "events").group_by("user_id").aggregate(agg.count(), "n")
    return counts.each(F.floor(F.col("n") / 10), "bucket").group_by("bucket").aggregate(agg.count(), "keys").df


# Partitioning

@registered("select n_nationkey, unnest(range(3))::int target from nation")
def replicate(spark, d):
    return read(spark, d, "nation").project("n_nationkey").broadcast(3).df


@registered("select c_custkey, unnest(case when c_nationkey % 2 = 0 then [c_custkey % 4, 4] else [c_custkey % 4] end)::int target from customer")
def custom_grouping(spark, d):
    home = (F.col("c_custkey") % 4).cast("int")
    target = F.when(F.col("c_nationkey") % 2 == 0, F.array(home, F.lit(4))).otherwise(F.array(home))
    return read(spark, d, "customer").partition(target, 5).project("c_custkey", "target").df


@registered("select o_custkey, count(*) n from orders group by 1")
def repartitioned(spark, d):
    s = read(spark, d, "orders").project("o_custkey").shuffle(8).local_or_shuffle().partition_by("o_custkey", n=8).identity_partition()
    return s.group_by("o_custkey").aggregate(agg.count(), "n").df


# Joins and sets

@registered("select o_custkey k, o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def join_inner(spark, d):
    return join([(read(spark, d, "orders").project("o_custkey", "o_orderkey"), ["o_custkey"]), (read(spark, d, "customer").project("c_custkey", "c_name"), ["c_custkey"])], ["k", "o_orderkey", "c_name"]).df


def _sided(spark, d, types):
    """All rows: odd customers get keys that no order has, every third customer's orders get a null key."""
    customers = read(spark, d, "customer").each(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")), "ck").project("ck", "c_name")
    orders = read(spark, d, "orders").each(F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")), "ok").project("ok", "o_orderkey")
    return join([(customers, ["ck"]), (orders, ["ok"])], ["k", "c_name", "o_orderkey"], types).df


SIDED = "select coalesce(ck, ok) k, c_name, o_orderkey from (select case when c_custkey % 2 = 0 then c_custkey else -c_custkey end ck, c_name from customer) {how} join (select case when o_custkey % 3 <> 0 then o_custkey end ok, o_orderkey from orders) on ck = ok"


@registered(SIDED.format(how="left"))
def join_left(spark, d):
    return _sided(spark, d, [INNER, OUTER])


@registered(SIDED.format(how="right"))
def join_right(spark, d):
    return _sided(spark, d, [OUTER, INNER])


@registered(SIDED.format(how="full"))
def join_full(spark, d):
    return _sided(spark, d, [OUTER, OUTER])


@registered("select n_nationkey k, c_custkey, n_name, s_suppkey from customer join nation on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey")
def join_three_way(spark, d):
    sides = [(read(spark, d, "customer").project("c_nationkey", "c_custkey"), ["c_nationkey"]), (read(spark, d, "nation").project("n_nationkey", "n_name"), ["n_nationkey"]),
             (read(spark, d, "supplier").project("s_nationkey", "s_suppkey"), ["s_nationkey"])]
    return join(sides, ["k", "c_custkey", "n_name", "s_suppkey"], many=True).df


@registered("""select c_nationkey k, n_name, s_suppkey, c_custkey from customer
    left join (select case when n_nationkey % 2 = 0 then n_nationkey else -n_nationkey end nk, n_name from nation) on nk = c_nationkey
    left join (select case when s_nationkey % 3 = 0 then s_nationkey else -s_nationkey end sk, s_suppkey from supplier) on sk = c_nationkey""")
def join_mixed(spark, d):
    moved = lambda key, n: F.when(F.col(key) % n == 0, F.col(key)).otherwise(-F.col(key))
    sides = [(read(spark, d, "nation").each(moved("n_nationkey", 2), "nk").project("nk", "n_name"), ["nk"]),
             (read(spark, d, "supplier").each(moved("s_nationkey", 3), "sk").project("sk", "s_suppkey"), ["sk"]),
             (read(spark, d, "customer").project("c_nationkey", "c_custkey"), ["c_nationkey"])]
    return join(sides, ["k", "n_name", "s_suppkey", "c_custkey"], [OUTER, OUTER, INNER]).df


@registered("select a.k, a.n_nationkey x, b.n_nationkey y from (select nullif(n_regionkey, 0) k, * from nation) a join (select nullif(n_regionkey, 0) k, * from nation) b on a.k is not distinct from b.k")
def join_null_keys(spark, d):
    s = read(spark, d, "nation").each(F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")), "k").project("k", "n_nationkey")
    return join([(s, ["k"]), (s, ["k"])], ["k", "x", "y"]).df


@registered("select a.b __batch_id, o_orderkey, l_linenumber from (select o_orderkey % 10 b, * from orders) a join (select (l_orderkey + l_linenumber // 4) % 10 b, * from lineitem) l on a.b = l.b and o_orderkey = l_orderkey")
def join_per_batch(spark, d):
    orders = tables.in_batches(tables.table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey") % 10)
    lines = tables.in_batches(tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), (F.col("l_orderkey") + F.floor(F.col("l_linenumber") / 4)) % 10)
    return join([(orders, ["o_orderkey"]), (lines, ["l_orderkey"])], ["o_orderkey", "l_linenumber"]).df


@registered("select doc_id, quality, lang from labels join documents using (doc_id)")
def natural(spark, d):
    return natural_join([read(spark, d, "labels"), read(spark, d, "documents").project("doc_id", "lang")], ["doc_id", "quality", "lang"]).df


@registered("select n_nationkey k, (select count(*) from customer where c_nationkey = n_nationkey) customers, (select count(*) from supplier where s_nationkey = n_nationkey) suppliers from nation")
def multi_reducer(spark, d):
    sides = [(read(spark, d, "nation").project("n_nationkey"), ["n_nationkey"]), (read(spark, d, "customer").project("c_nationkey"), ["c_nationkey"]), (read(spark, d, "supplier").project("s_nationkey"), ["s_nationkey"])]
    counted = multi_reduce(sides, lambda key, rs: [(len(rs[1]), len(rs[2]))] if rs[0] else [], "customers long, suppliers long")
    return counted.df.withColumnRenamed("n_nationkey", "k")


@registered("select c_custkey id, c_name name from customer union all select s_suppkey, s_name from supplier")
def merge(spark, d):
    return read(spark, d, "customer").project("c_custkey", "c_name").merge(read(spark, d, "supplier").project("s_suppkey", "s_name"), out=["id", "name"]).df


# Top-n

@registered("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def first_n_sorted(spark, d):
    return read(spark, d, "orders").project("o_orderkey", "o_totalprice").first_n(25, "o_totalprice", reverse=True, ties=["o_orderkey"]).df


@registered("select __batch_id, o_orderkey, o_totalprice from (select o_custkey % 10 __batch_id, *, row_number() over (partition by o_custkey % 10 order by o_totalprice, o_orderkey) r from orders) where r <= 3")
def first_n_per_batch(spark, d):
    s = tables.in_batches(tables.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), F.col("o_custkey") % 10)
    return s.first_n(3, "o_totalprice", ties=["o_orderkey"]).df.select(BATCH, "o_orderkey", "o_totalprice")


@registered("select count(*) n from (select * from orders limit 100)")
def first_n(spark, d):
    return read(spark, d, "orders").first_n(100).aggregate(agg.count(), "n").df


@registered("select user_id, n, (row_number() over (order by n desc, user_id))::int rank from (select user_id, count(*) n from events group by 1) order by n desc, user_id limit 10")
def rankings(spark, d):
    counts = read(spark, d, "events").group_by("user_id").aggregate(agg.count(), "n").df
    return topn.rankings(counts, "user_id", "n", 10)


@registered("select * from (select event_type, user_id, n, (row_number() over (partition by event_type order by n desc, user_id))::int rank from (select event_type, user_id, count(*) n from events group by 1, 2)) where rank <= 5")
def rankings_per_type(spark, d):
    counts = read(spark, d, "events").group_by("event_type", "user_id").aggregate(agg.count(), "n").df
    return topn.rankings(counts, "user_id", "n", 5, per=["event_type"])


# Windows

@registered("""with s as (select user_id, floor(epoch(ts))::bigint // 3600 slot, count(*) n from events group by 1, 2), r as (select user_id, slot + k slot, n from s, range(4) t(k))
    select user_id, slot::bigint slot, sum(n)::bigint total from r where slot <= (select max(slot) from s) group by 1, 2""")
def sliding_window_counts(spark, d):
    events = tables.table(spark, d, "events").select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("slot"))
    last = events.agg(F.max("slot")).first()[0] or 0
    return windows.sliding_counts(windows.slot_counts(events, "user_id", "slot"), "user_id", "slot", "n", 4, last)


@registered("select event_type, epoch_ms(b * 3000 - k * 3000) \"start\", epoch_ms(b * 3000 - k * 3000 + 9000) \"end\", count(*) n from (select event_type, epoch_us(ts) // 3000000 b from events), range(3) t(k) group by 1, 2, 3")
def rolling_counts(spark, d):
    out = windows.rolling_counts(tables.table(spark, d, "events"), "ts", ["event_type"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@registered("""with c as (select epoch_us(ts) // 3600000000 slot, user_id, count(*) n from events group by 1, 2), r as (select slot + k slot, user_id, sum(n)::bigint n from c, range(3) t(k) group by 1, 2)
    select slot::bigint slot, user_id, n, rank from (select *, (row_number() over (partition by slot order by n desc, user_id))::int rank from r) where rank <= 3""")
def rolling_top_n(spark, d):
    events = tables.table(spark, d, "events").select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("slot"))
    totals = windows.sliding_counts(windows.slot_counts(events, "user_id", "slot"), "user_id", "slot", "n", 3).withColumnRenamed("total", "n")
    return topn.rankings(totals, "user_id", "n", 3, per=["slot"])


@registered("select event_id, user_id, (row_number() over (partition by user_id order by event_id))::int running from events")
def running_count(spark, d):
    return windows.running_count(tables.table(spark, d, "events").select("event_id", "user_id"), "user_id", [F.col("event_id")])


@registered("select event_id, row_number() over (order by event_id) running from events")
def global_running_count(spark, d):
    return windows.global_running_count(tables.table(spark, d, "events").select("event_id"), "event_id")


@registered("""select event_id, (sum(v - coalesce(p, 0)) over (order by event_id))::bigint total from
    (select event_id, v, lag(v) over (partition by user_id order by event_id) p from (select event_id, user_id, floor(value)::bigint v from events))""")
def latest_totals(spark, d):
    events = tables.table(spark, d, "events").select("event_id", "user_id", F.floor("value").alias("v"))
    return windows.latest_totals(events, "user_id", "v", "event_id")


@registered("""select l_partkey, l_orderkey, l_linenumber, round(sum(l_extendedprice * l_quantity) over w / sum(l_quantity) over w, 3) vwap, sum(l_quantity) over w volume_total,
    round(sum(l_extendedprice * l_extendedprice * l_quantity) over w / sum(l_quantity) over w - pow(sum(l_extendedprice * l_quantity) over w / sum(l_quantity) over w, 2), -2) + 0.0 variance
    from lineitem window w as (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber rows between 99 preceding and current row)""")
def vwap_100(spark, d):
    lines = tables.table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate")
    out = windows.trade_statistics(lines, "l_partkey", "l_extendedprice", "l_quantity", [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber")])
    return out.select("l_partkey", "l_orderkey", "l_linenumber", F.round("vwap", 3).alias("vwap"), "volume_total", (F.round("variance", -2) + F.lit(0.0)).alias("variance"))


@registered("""select event_id, user_id, floor(epoch(ts))::bigint - floor(epoch(first_value(ts) over (partition by user_id order by ts, event_id rows between 3 preceding and current row)))::bigint "seconds" from events""")
def actual_length(spark, d):
    events = tables.table(spark, d, "events").select("event_id", "user_id", "ts")
    return windows.actual_length(events, "user_id", "ts", 3, ties=["event_id"]).select("event_id", "user_id", "seconds")


@registered("select event_type, floor(epoch(ts) / 60)::bigint * 60 \"start\", count(*) n, count(*) / 60.0::double per_second from events group by 1, 2")
def rate_per_second(spark, d):
    return windows.rates(tables.table(spark, d, "events"), "ts", 60, ["event_type"])


@registered("""with e as (select event_type, value, floor(epoch((select max(ts) from events)))::bigint - floor(epoch(ts))::bigint age from events), w(name, len) as (values ('600', 600), ('10800', 10800), ('86400', 86400), ('all', 1000000000000))
    select event_type, name "window", count(*) n, round(avg(value), 6) mean from e join w on age < len group by 1, 2""")
def windowed_stats(spark, d):
    events = tables.table(spark, d, "events")
    now = events.agg(F.max("ts")).first()[0]
    out = windows.windowed_stats(events, "ts", "value", ["event_type"], F.lit(now), {"600": 600, "10800": 10800, "86400": 86400})
    return out.withColumn("mean", F.round("mean", 6))


# State

def _counts(spark, d, kind, name):
    state = StateTable(spark, fresh_path(spark, name), "user_id long", "n long", kind)
    events = tables.table(spark, d, "events").select("event_id", "user_id")
    return state, events.filter(F.col("event_id") % 2 == 0), events.filter(F.col("event_id") % 2 == 1)


def _update(state, batch, epoch):
    return runner.update_state(batch, ["user_id"], agg.count(), state, epoch)


@registered("select user_id, count(*) n from events group by 1")
def persistent_count(spark, d):
    state, even, odd = _counts(spark, d, TRANSACTIONAL, "persistent")
    _update(state, even, 1)
    _update(state, even, 1)  # a repeat of the same batch changes nothing
    _update(state, odd, 2)
    return state.snapshot()


@registered("select user_id, sum(event_id * 2)::bigint n from events group by 1")
def persistent_reduce(spark, d):
    state, even, odd = _counts(spark, d, OPAQUE, "reduce")
    doubled = agg.Reducer(lambda: 0, lambda now, r: now + 2 * r["event_id"], "long")
    for batch, epoch in ((even, 1), (odd.limit(0), 2), (odd, 2)):  # the second batch comes again, with rows
        runner.update_state(batch, ["user_id"], doubled, state, epoch, order=["event_id"])
    return state.snapshot()


@registered("select max(event_id)::bigint n from events")
def persistent_combine_global(spark, d):
    state = StateTable(spark, fresh_path(spark, "combine"), "", "n long", TRANSACTIONAL)
    events = tables.table(spark, d, "events").select("event_id")
    largest = agg.Combiner(lambda r: r["event_id"], max, lambda: 0, "long")
    for part, epoch in ((0, 1), (0, 1), (1, 2)):
        runner.update_state(events.filter(F.col("event_id") % 2 == part), [], largest, state, epoch)
    return state.snapshot()


@registered("select string_agg(r_name, ',' order by r_regionkey) names from region")
def persistent_reduce_global(spark, d):
    state = StateTable(spark, fresh_path(spark, "reduce-all"), "", "names string", OPAQUE)
    joined = agg.Reducer(lambda: "", lambda now, r: (now and now + ",") + r["r_name"], "string")
    regions = tables.table(spark, d, "region").select("r_regionkey", "r_name")
    for low, epoch in ((0, 1), (2, 2)):
        runner.update_state(regions.filter(F.col("r_regionkey").between(low, 1 if low == 0 else 10**9)), [], joined, state, epoch, order=["r_regionkey"])
    return state.snapshot()


@registered("""with c as (select user_id, count(*) filter (where event_id % 2 = 1) a, count(*) filter (where event_id % 4 = 2) b, count(*) filter (where event_id % 4 = 0) c from events group by 1)
    select user_id, case when c > 0 then a + c else a + b end n from c""")
def opaque_replay(spark, d):
    state, even, odd = _counts(spark, d, OPAQUE, "opaque")
    _update(state, odd, 1)
    _update(state, even.filter("event_id % 4 = 2"), 2)
    _update(state, even.filter("event_id % 4 <> 2"), 2)  # the same batch came again with other rows
    return state.snapshot()


@registered("select user_id, (count(*) + count(*) filter (where event_id % 2 = 0))::bigint n from events group by 1")
def non_transactional_replay(spark, d):
    state, even, odd = _counts(spark, d, NON_TRANSACTIONAL, "plain")
    _update(state, even, 1)
    _update(state, even, 1)
    _update(state, odd, 2)
    return state.snapshot()


@registered("select user_id, count(*) n from events where user_id % 3 <> 0 group by 1")
def state_remove(spark, d):
    state, even, odd = _counts(spark, d, TRANSACTIONAL, "remove")
    _update(state, even.unionByName(odd), 1)
    state.remove(even.unionByName(odd).filter("user_id % 3 = 0").select("user_id"), 2)
    return state.snapshot()


@registered("""with c as (select user_id, count(*) n, count(*) filter (where event_id % 2 = 0) a from events group by 1)
    select user_id, case when n = a then '[1,' || n || ',null]' else '[2,' || n || ',' || case when a > 0 then a::varchar else 'null' end || ']' end json from c""")
def state_json(spark, d):
    state, even, odd = _counts(spark, d, OPAQUE, "json")
    _update(state, even, 1)
    _update(state, odd, 2)
    return state.as_json()


@registered("select o_orderkey, c_name name from orders left join (select * from customer where c_custkey % 2 = 0) on o_custkey = c_custkey")
def map_get(spark, d):
    state = StateTable(spark, fresh_path(spark, "names"), "c_custkey long", "c_name string")
    # All customers are put; the odd ones under keys that no order asks for.
    key = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey"))
    state.put(tables.table(spark, d, "customer").select(key.alias("c_custkey"), "c_name"), 1)
    orders = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return query.map_get(orders, state.snapshot(), [("o_custkey", "c_custkey")], "c_name", "name").select("o_orderkey", "name")


@registered("select r_regionkey, (select count(*) from orders) total from region")
def snapshot_get(spark, d):
    state = StateTable(spark, fresh_path(spark, "total"), "", "n long")
    orders = tables.table(spark, d, "orders")
    for epoch in (0, 1):
        runner.update_state(orders.filter(F.col("o_orderkey") % 2 == epoch), [], agg.count(), state, epoch)
    return query.snapshot_get(tables.table(spark, d, "region").select("r_regionkey"), state.snapshot(), "n", "total")


@registered("select r_regionkey, n_nationkey, n_name from region, nation")
def collection_get(spark, d):
    state = StateTable(spark, fresh_path(spark, "nations"), "n_nationkey int", "n_name string")
    state.put(tables.table(spark, d, "nation").select("n_nationkey", "n_name"), 1)
    return query.collection_get(tables.table(spark, d, "region").select("r_regionkey"), state.snapshot())


# Requests

@registered("select p_partkey request_id, (select count(distinct o_custkey) from lineitem join orders on l_orderkey = o_orderkey where l_partkey = p_partkey) reach from part")
def reach(spark, d):
    asked = tables.table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_partkey").cast("string").alias("args"))
    lines = tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("url"), F.col("l_orderkey").alias("user"))
    orders = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("user"), F.col("o_custkey").alias("follower"))
    return requests.reach(asked, lines, orders, "url", "user", "follower")


@registered(f"select n_nationkey::bigint request_id, args, coalesce(sum(c), 0)::bigint total from (select n_nationkey, 'the of ' || lower(n_name) args, unnest(['the', 'of', lower(n_name)]) word from nation) left join (select word, count(*) c from ({WORDS}) group by 1) using (word) group by 1, 2")
def request_word_sums(spark, d):
    counts = word_count(spark, d)
    asked = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("request_id"), F.concat(F.lit("the of "), F.lower("n_name")).alias("args"))
    words = Stream(asked).each(rows.split_words(F.col("args")), "word", flat=True).df
    found = query.map_get(words, counts, [("word", "word")], "n", "c")
    return found.groupBy("request_id", "args").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"))


@registered("select n_nationkey::bigint request_id, n_nationkey::varchar args, '[[\"' || n_nationkey * n_nationkey || '\"]]' result from nation")
def request_square(spark, d):
    functions = requests.Functions(spark)
    functions.register("square", requests.linear(lambda df: df.withColumn("square", rows.square(F.col("args").cast("long")))), ["square"])
    asked = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("request_id"), F.col("n_nationkey").cast("string").alias("args"))
    return functions.run("square", asked)


# Elastic analysis

SHARDED = "(select o_custkey % 256 shard, count(*) load from orders group by 1)"


@registered(f"select s::int shard, coalesce(load, 0) load from range(256) t(s) left join {SHARDED} on s = shard")
def shard_histogram(spark, d):
    return elastic.histogram(tables.table(spark, d, "orders").select(elastic.shard_of(F.col("o_custkey")).alias("shard")), "shard", 256)


ROUTED = "(select (o_custkey % 256) % 7 route, count(*) load from orders group by 1)"


def _routes(spark, d):
    df = elastic.route(tables.table(spark, d, "orders").select("o_custkey"), F.col("o_custkey"), elastic.initial_mapping(256, 7))
    return elastic.histogram(df, "route", 7)


@registered(f"select route::int route, load from {ROUTED}")
def route_histogram(spark, d):
    return _routes(spark, d)


@registered(f"select round((max(load) - min(load)) / max(load), 9) skew, (max(load) - min(load)) / max(load) >= 0.2 skewed from {ROUTED}")
def skew_factor(spark, d):
    return elastic.skewness(_routes(spark, d)).withColumn("skew", F.round("skew", 9))


@registered(f"select round(least(1.0, avg(load) / max(load)), 9) factor, max(load) largest from {SHARDED}")
def performance_factor(spark, d):
    loads = tables.table(spark, d, "orders").groupBy(elastic.shard_of(F.col("o_custkey")).alias("shard")).agg(F.count(F.lit(1)).alias("load"))
    return elastic.performance(loads).withColumn("factor", F.round("factor", 9))


@registered("select o_orderkey, (case when (o_custkey % 256) % 7 in (2, 5) then -2 else (o_custkey % 256) % 7 end)::int route from orders")
def partial_routing(spark, d):
    df = elastic.route(tables.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey"), elastic.initial_mapping(256, 7))
    return df.select("o_orderkey", elastic.partial_route(F.col("route"), [2, 5]).alias("route"))


@registered()
def rebalance_plan(spark, d):
    return elastic.plan_moves(tables.table(spark, d, "orders"), F.col("o_custkey"), 7)


@registered()
def bin_packing(spark, d):
    counts = tables.table(spark, d, "orders").groupBy(elastic.shard_of(F.col("o_custkey")).alias("shard")).count().collect()  # at most 256 rows
    return spark.createDataFrame(sorted(elastic.pack_decreasing({r["shard"]: r["count"] for r in counts}, 7).items()), "shard int, bin int")


@registered("select l_suppkey, bit_xor(l_orderkey) \"xor\", count(*) n from lineitem group by 1")
def xor_check(spark, d):
    return validators.xor_check(tables.table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


@registered("select * from (select user_id, event_id, lag(event_id) over (partition by user_id order by event_id) \"before\" from events) where event_id <> \"before\" + 1")
def sequence_gaps(spark, d):
    return validators.gaps(tables.table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", "event_id")


@registered()
def order_book(spark, d):
    lines = tables.table(spark, d, "lineitem")
    orders = lines.select(F.col("l_partkey").alias("sec_code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_no"), F.col("l_shipdate").alias("ts"),
                          F.when(F.col("l_returnflag") == "N", "B").otherwise("S").alias("direction"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 0).alias("price"),
                          F.col("l_quantity").cast("long").alias("volume"))
    return orderbook.match(orders)


# Sources and plans

@registered("select n_nationkey::bigint id, n_name name from nation")
def json_scheme(spark, d):
    messages = tables.table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).cast("binary").alias("value"))
    return schemes.json(messages, "id long, name string")


@registered("select r_regionkey, n_nationkey from region join nation on n_regionkey = r_regionkey")
def json_rows_scheme(spark, d):
    groups = tables.table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey"))).cast("binary").alias("value"))
    return schemes.json_rows(groups, "n_nationkey int").withColumnRenamed("n_regionkey", "r_regionkey")


@registered()
def zipf_histogram(spark, d):
    n = tables.table(spark, d, "events").count()
    return generators.zipf(spark, n, 100, 1.1).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@registered("select lang, count(*) n from documents where lang <> 'de' group by lang order by n desc, lang limit 3")
def plan_from_data(spark, d):
    spec = {"steps": [{"name": "kept", "from": "docs", "op": "filter", "condition": "lang <> '${skip}'"}, {"name": "counts", "from": "kept", "op": "group_count", "by": ["lang"], "out": "n"},
                      {"name": "top", "from": "counts", "op": "first_n", "n": 3, "sort": "n", "reverse": True, "ties": ["lang"]}]}
    return builder.from_spec(spec, {"docs": read(spark, d, "documents").project("lang")}, {"skip": "de"})["top"].df


# Streams: each gives what the static operator gives

def _stream(spark, d, name, order, parts=4):
    """A table as a stream of several batches: written part by part, in ranges of ``order``, one file a batch."""
    df, path = tables.table(spark, d, name), fresh_path(spark, f"stream-{name}")
    low, high = df.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((order - F.lit(low)) * parts / F.lit(max(1, high - low))), F.lit(parts - 1)) if low is not None else F.lit(0)
    for i in range(parts):
        df.filter(F.coalesce(part, F.lit(0)) == i).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _documents():
    return "documents", F.col("doc_id")


def _events():
    return "events", F.unix_micros(F.col("ts").cast("timestamp"))


@registered(ORACLE_SQL["word_count"])
def stream_word_count(spark, d):
    s = Stream(_stream(spark, d, *_documents()).select("text")).each(rows.split_words(F.col("text")), "word", flat=True)
    return runner.drain(s.group_by("word").aggregate(agg.count(), "n").df, "complete")


@registered(ORACLE_SQL["rolling_counts"])
def stream_rolling_counts(spark, d):
    events = _stream(spark, d, *_events()).withColumn("ts", F.col("ts").cast("timestamp"))
    out = runner.drain(windows.rolling_counts(events, "ts", ["event_type"]), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@registered(ORACLE_SQL["persistent_count"])
def stream_persistent_count(spark, d):
    state = StateTable(spark, fresh_path(spark, "stream-state"), "user_id long", "n long", TRANSACTIONAL)
    runner.persistent_aggregate(_stream(spark, d, *_events()).select("user_id"), ["user_id"], agg.count(), state, fresh_path(spark, "checkpoint")).awaitTermination()
    return state.snapshot()


@registered("select user_id::varchar \"key\", max(running) largest, count(*) n from (select user_id, row_number() over (partition by user_id order by event_id) running from events) group by 1")
def stream_running_count(spark, d):
    processors.use_rocksdb(spark)
    out = runner.drain(processors.running_count_stream(_stream(spark, d, *_events()).select(F.col("user_id").cast("string").alias("user_id")), "user_id"), "append")
    return out.groupBy("key").agg(F.max("running").alias("largest"), F.count(F.lit(1)).alias("n"))


@registered("select a.event_id x, b.event_id y from events a join events b on a.user_id = b.user_id and b.ts between a.ts - interval 60 second and a.ts + interval 60 second where a.event_type = 'click' and b.event_type = 'purchase'")
def stream_interval_join(spark, d):
    events = _stream(spark, d, *_events()).withColumn("ts", F.col("ts").cast("timestamp"))
    left = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("x"), F.col("ts").alias("left_ts"))
    right = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("y"), F.col("ts").alias("right_ts"))
    return runner.drain(runner.interval_join(left, right, "user_id", "left_ts", "right_ts", "60 seconds", "1 minute").select("x", "y"))


@registered("select user_id, count(*) \"count\" from events group by 1 order by 2 desc, 1 limit 10")
def stream_rolling_top(spark, d):
    return runner.drain(runner.rolling_top(_stream(spark, d, *_events()).select("user_id"), "user_id", 10), "complete")
