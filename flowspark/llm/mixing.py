"""Temperature mixing of sources: weights from tempered token shares, realised as budgeted permutations.

A source's weight is its token share raised to an exponent, normalised. The exponent is bisected to meet a
target entropy or a limit on repetition. Each source is then read as a chain of epochs, each a full
permutation of its documents, cut where the source's token budget ends. A permutation is the order of a
64-bit hash of (seed, epoch, document), so that membership in a cut epoch is one comparison per row and
texts are never shuffled.

Sources may be many: their table stays a table. The driver sees sums over it; it is broadcast only where Spark
finds it small enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import save

#: Fixed value: a permutation is cut into this many hash ranges for prefix sums (per source and epoch).
RANGES = 4096
#: Bits of the exponent, and bits settled by one pass over the sources.
BITS = 30
STEP = 6


def n_tokens(text: Column) -> Column:
    """Words of ``text``; null and blank text have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def tempered(shares: list[float], exponent: float) -> list[float]:
    raised = [s ** exponent if s > 0 else 0.0 for s in shares]
    total = sum(raised)
    return [x / total for x in raised] if total else raised


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def _least(holds) -> float:
    """The least multiple of 2**-BITS in [0, 1] for which ``holds`` is true, 1 if for none. ``holds`` takes a list of
    exponents and says of each, in one go; it is false up to some exponent and true from there on."""
    low, step = 0, 1 << BITS  # the answer lies in (low - step, low] once a pass is done; first, anywhere in [0, 1]
    if holds([0.0])[0]:
        return 0.0
    while step > 1:
        step = max(1, step >> STEP)
        tried = [low + step * (i + 1) for i in range((1 << STEP) - 1)]
        found = holds([min(1.0, t / (1 << BITS)) for t in tried])
        low += step * next((i for i, ok in enumerate(found) if ok), len(tried))
    return min(1.0, (low + 1) / (1 << BITS))


def spread_exponent(least: float, largest: float, max_repetition: float) -> float:
    """The least exponent at which no source repeats more than ``max_repetition`` times as often as another, given the
    least and the largest share: rates go as share ** (exponent - 1)."""
    return _least(lambda tried: [(largest / least) ** (1 - a) <= max_repetition for a in tried])


def solve_exponent(shares: list[float], target_entropy: float | None, max_repetition: float | None) -> float:
    """The exponent in [0, 1] whose weights have ``target_entropy`` (a share of the largest possible), raised
    if need be until no source repeats more than ``max_repetition`` times as often as another."""
    live = [s for s in shares if s > 0]
    return _solved(len(live), min(live, default=0), max(live, default=0), lambda tried: [entropy(tempered(live, a)) for a in tried], target_entropy, max_repetition)


def _solved(n: int, least: float, largest: float, entropies, target_entropy: float | None, max_repetition: float | None) -> float:
    if n < 2:
        return 1.0
    found = 1.0
    if target_entropy is not None:
        goal = target_entropy * math.log(n)
        found = _least(lambda tried: [e <= goal for e in entropies(tried)])
    elif max_repetition is not None:
        found = 0.0
    return max(found, spread_exponent(least, largest, max_repetition)) if max_repetition is not None else found


def narrowed(docs: DataFrame) -> DataFrame:
    """(source, doc_id, print, n) of each row, written once: all statistics come from it, not from the texts."""
    return save(docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), n_tokens(F.col("text")).alias("n")), "sizes")


def sources(narrow: DataFrame, target_entropy: float | None = 0.95, max_repetition: float | None = 4.0, budget: int | None = None) -> DataFrame:
    """Per source: tokens, docs, share, weight, exponent and how often it is read (``rate``) within the token ``budget``.

    Without a budget it is the smallest at which each source is read once in full, so that no document is
    lost. A source without tokens has weight 0 and is read once.
    """
    table = save(narrow.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    live = table.filter("tokens > 0")
    total, least, largest, n = live.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count(F.lit(1))).first()
    share = F.col("tokens") / F.lit(float(total or 1))

    def entropies(tried: list[float]) -> list[float]:
        sums = [x for a in tried for x in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]
        row = live.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        return [math.log(row[2 * i]) - a * row[2 * i + 1] / row[2 * i] for i, a in enumerate(tried)]

    exponent = _solved(n, (least or 0) / (total or 1), (largest or 0) / (total or 1), entropies, target_entropy, max_repetition)
    raised = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent))).otherwise(0.0)
    whole, most = table.agg(F.sum(raised), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / raised))).first()
    weight = raised / F.lit(whole or 1.0)
    spent = float(budget) if budget is not None else (most or 0.0) * (whole or 1.0)
    rate = F.when(F.col("tokens") > 0, weight * F.lit(spent) / F.col("tokens")).otherwise(1.0)
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    return save(table.select("source", "tokens", "docs", share.alias("share"), weight.alias("weight"), F.lit(exponent).alias("exponent"), rate.alias("rate")), "weights")


def weights(narrow: DataFrame, target_entropy: float | None = 0.95, max_repetition: float | None = 4.0, budget: int | None = None) -> list[dict]:
    """The rows of ``sources``, for reports; the operators use the table."""
    return [r.asDict() for r in sources(narrow, target_entropy, max_repetition, budget).orderBy(F.col("source").asc_nulls_first()).toLocalIterator()]


def _key(seed: int, epoch: Column, doc_id: Column, print_: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, doc_id, print_)


def _range(key: Column) -> Column:
    """Of a signed 64-bit key, the number of its range, in key order."""
    return (F.shiftright(key, 52) + RANGES // 2).cast("int")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _plan(narrow: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """(source, full, last, cut): a source is read ``full`` times, and in epoch ``last`` up to and with the key ``cut``;
    ``last`` is -1 if there is no such epoch."""
    full = F.when(F.col("tokens") > 0, F.floor("rate")).otherwise(1).cast("int")
    partly = (F.col("tokens") > 0) & (F.col("rate") > F.floor("rate"))
    goals = table.filter(partly).select(F.col("source").alias("src"), full.alias("epoch"), ((F.col("rate") - F.floor("rate")) * F.col("tokens")).alias("goal"))
    keyed = narrow.join(goals, _same("source", "src")).withColumn("key", _key(seed, F.col("epoch"), F.col("doc_id"), F.col("print")))
    keyed = keyed.select("src", "goal", "key", "n", _range(F.col("key")).alias("r"))
    ranges = keyed.groupBy("src", "goal", "r").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("src").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a source
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    edge = ranges.filter((F.col("before") < F.col("goal")) & (F.col("before") + F.col("n") >= F.col("goal"))).select(F.col("src").alias("s"), F.col("r").alias("e"), "before")
    inside = keyed.join(edge, _same("src", "s") & (F.col("r") == F.col("e")))
    running = Window.partitionBy("src").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.withColumn("sum", F.col("before") + F.sum("n").over(running)).filter(F.col("sum") >= F.col("goal"))
    cuts = reached.groupBy(F.col("src").alias("cut_source")).agg(F.min("key").alias("cut"))
    plan = table.join(cuts, _same("source", "cut_source"), "left")
    last = F.when(partly, full).otherwise(-1)
    return save(plan.select("source", full.alias("full"), last.alias("last"), F.coalesce("cut", F.lit((1 << 63) - 1)).alias("cut")), "plan")


def _read(rows: DataFrame, plan: DataFrame, seed: int, names: tuple[str, ...]) -> DataFrame:
    """``rows`` (doc_id, source, print and others) once for each epoch that reads them, without ``print``: adds the
    columns ``names``, for epoch and key."""
    source, full, last, cut = (f"plan_{c}" for c in plan.columns)
    rows = rows.join(plan.toDF(source, full, last, cut), _same("source", source))
    partly = (F.col(last) >= 0) & (_key(seed, F.col(last), F.col("doc_id"), F.col("print")) <= F.col(cut))
    epochs = F.col(full) + F.when(partly, 1).otherwise(0)
    rows = rows.filter(epochs > 0).withColumn(names[0], F.explode(F.sequence(F.lit(0), epochs - 1)))
    rows = rows.withColumn(names[1], _key(seed, F.col(names[0]), F.col("doc_id"), F.col("print")))
    return rows.drop(source, full, last, cut, "print")


def mix(docs: DataFrame, target_entropy: float | None = 0.95, max_repetition: float | None = 4.0, budget: int | None = None, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` as often as the mixture reads them, columns unchanged; texts are not shuffled as long as
    the table of sources is small enough to be broadcast.

    Without ``budget`` each document is read at least once. With one, larger sources may be read in part: that
    is the mixture's purpose, and the only case in which a document is left out.

    Null source is a source of its own; null or empty text has no tokens; a source without tokens is read
    once. Repeated rows stand at the same place and are read alike. Other columns pass through; an empty table
    stays empty.
    """
    narrow = narrowed(docs)
    plan = _plan(narrow, sources(narrow, target_entropy, max_repetition, budget), seed)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no names to clash with
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("print"))
    return _read(rows, plan, seed, ("epoch", "key")).select("row.*")


def schedule(docs: DataFrame, target_entropy: float | None = 0.95, max_repetition: float | None = 4.0, budget: int | None = None, seed: int = 0,
             block_tokens: int = 1 << 20) -> DataFrame:
    """The mixture as an order: (doc_id, source, epoch, n_tokens, block, place, weight) for each reading.

    The stream is a row of blocks of about ``block_tokens`` tokens (and as many readings at most, on average). Each
    source spreads its readings evenly over all blocks, so that every block realises the weights; ``place`` orders the
    readings within a block. Readings without tokens go to blocks by hash. Nulls, repeats and empty tables are as for
    ``mix``.
    """
    narrow = narrowed(docs)
    table = sources(narrow, target_entropy, max_repetition, budget)
    rows = _read(narrow, _plan(narrow, table, seed), seed, ("epoch", "key"))
    rows = save(rows.select("doc_id", "source", "epoch", "key", "n", _range(F.col("key")).alias("r")), "mixture")
    tokens = table.agg(F.sum(F.col("rate") * F.col("tokens"))).first()[0] or 0
    blocks = max(1, math.ceil(tokens / block_tokens), math.ceil(rows.count() / block_tokens))
    sums = rows.groupBy("source", "epoch", "r").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("epoch", "r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("r").alias("q"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "epoch", "r").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(offsets, _same("source", "s") & (F.col("epoch") == F.col("e")) & (F.col("r") == F.col("q")))
    quotas = table.select(F.col("source").alias("src"), "weight", F.greatest(F.lit(1.0), F.col("rate") * F.col("tokens")).alias("quota"))
    placed = placed.join(quotas, _same("source", "src"))
    by_sum = F.least(F.lit(blocks - 1), F.floor((F.col("before") + F.col("inside")) * blocks / F.col("quota")))
    block = F.when(F.col("n") > 0, by_sum).otherwise(F.pmod(F.xxhash64("key", "doc_id"), F.lit(blocks))).cast("long")
    order = Window.partitionBy("block").orderBy(F.xxhash64("key"), "doc_id", "epoch", "source")
    return placed.withColumn("block", block).withColumn("place", F.row_number().over(order)).select("doc_id", "source", "epoch", F.col("n").alias("n_tokens"), "block", "place", "weight")
