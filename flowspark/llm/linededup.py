"""Corpus-wide line dedup: keep frequent lines only in one document, described by keep bitmaps.

DataFrame functions only. Long lines become narrow rows (128-bit key, document, position). Keys with very
many rows are settled by partial aggregation; all others are range-partitioned by key and streamed in
(document, position) order. What comes back is, per document, a run-length bitmap, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import WHITE, ascii_lower, fresh, let, save

#: A key with more rows than this is hot: its documents are counted by partial aggregation, not in one sorted run.
HOT_ROWS = 20_000
#: Hot keys up to which their table (some 40 bytes a key) is broadcast; beyond, rows and keys meet salted.
BROADCAST_KEYS = 100_000
SALTS = 64
#: Rows of a hash range, about.
RANGE_ROWS = 1_000_000


def line_keys(text: Column) -> Column:
    """One struct (k1, k2) a line: 128 bits of the stripped, A-Z lower-cased line; ``chars`` its code points."""
    def key(line: Column) -> Column:
        return let(ascii_lower(F.btrim(line, F.lit(WHITE))), lambda s: F.struct(
            F.xxhash64(s).alias("k1"), F.xxhash64(F.lit("line"), s).alias("k2"), F.length(s).alias("chars")))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), key)


def _meet(rows: DataFrame, hot: DataFrame, keys: int, how: str) -> DataFrame:
    """``rows`` joined with ``hot``, a table of ``keys`` hot keys; a hot key's rows never meet in one task."""
    if keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(hot), ["k1", "k2"], how)
    salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["k1", "k2", "salt"], how).drop("salt")


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, print, drops): for each distinct (doc_id, text) the sorted positions of the lines it loses."""
    spark = docs.sparkSession
    rows = (docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("print"), F.posexplode(line_keys(F.col("text"))).alias("pos", "key"))
            .filter(F.col("key.chars") >= min_chars).select("doc", "print", "pos", "key.k1", "key.k2"))
    rows = save(rows, "lines")

    hot = save(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS).drop("n"), "hot-lines")
    keys, total = hot.count(), rows.count()
    summary = (_meet(rows, hot, keys, "inner").groupBy("k1", "k2")
               .agg(F.count_distinct(F.coalesce(F.col("doc").cast("string"), F.lit(""))).alias("docs"), F.max("doc").alias("home")))
    from_hot = _meet(rows, save(summary, "hot-summary"), keys, "inner").filter((F.col("docs") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("home")))

    # All others: ranges of the (uniform) first hash word, sorted by key, document and position, then streamed.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_ROWS)
    cold = _meet(rows, hot, keys, "left_anti").repartitionByRange(parts, "k1")
    order = Window.partitionBy("k1", "k2").orderBy(F.col("doc").desc_nulls_last(), "pos")
    whole = Window.partitionBy("k1", "k2").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = cold.withColumn("new", F.when(F.lag("doc").over(order).eqNullSafe(F.col("doc")), 0).otherwise(1))
    ranked = ranked.withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("docs", F.sum("new").over(whole))
    from_cold = ranked.filter((F.col("docs") >= min_docs) & (F.col("nth") > 1))

    lost = from_hot.select("doc", "print", "pos").unionByName(from_cold.select("doc", "print", "pos"))
    return lost.groupBy("doc", "print").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def kept_runs(n: Column, drops: Column) -> Column:
    """Run-length bitmap: (start, length) of each run of kept lines among ``n``, given sorted ``drops``."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drops, lambda p: p + 1))
    ends = F.concat(drops, F.array(n))
    return F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length"))), lambda r: r["length"] > 0)


def dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, out: str = "lines") -> DataFrame:
    """Add ``out``, a struct (n_lines, n_dropped, keep_runs, kept), to each row of ``docs``.

    A line's key is the line stripped of white space and A-Z lower-cased. Keys of at least ``min_chars`` code
    points found in at least ``min_docs`` documents lose all lines except those in the largest doc_id that
    holds them. ``keep_runs`` is the document's keep bitmap, run-length coded; ``kept`` the text that stays.

    Null or empty text is one empty line. All rows with a null doc_id count as one document, smaller than all
    others. Rows that share a doc_id count as one document and are answered one by one; repeated rows get equal
    answers. A column named ``out`` is replaced; other columns pass through. An empty table stays empty.
    """
    doc, print_, drops, key = (fresh(docs, f"lost_{name}") for name in ("doc", "print", "drops", "key"))
    lost = dropped_lines(docs, min_chars, min_docs).withColumnsRenamed({"doc": doc, "print": print_, "drops": drops})
    base = docs.drop(out).withColumn(key, F.xxhash64("text"))
    joined = base.join(lost, base["doc_id"].eqNullSafe(lost[doc]) & (base[key] == lost[print_]), "left")

    def result(lines: Column) -> Column:
        none = F.array().cast("array<int>")
        return let(kept_runs(F.size(lines), F.coalesce(F.col(drops), none)), lambda runs: F.struct(
            F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(drops), F.lit(0)).cast("long").alias("n_dropped"), runs.alias("keep_runs"),
            F.when(F.col(drops).isNull(), F.coalesce("text", F.lit("")))
            .otherwise(F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")).alias("kept")))

    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    return joined.withColumn(out, let(split, result)).drop(doc, print_, drops, key)


def clean(docs: DataFrame, **rules: int) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts; rows and columns as before."""
    lines = fresh(docs, "lines")
    return dedup(docs, **rules, out=lines).withColumn("text", F.col(lines)["kept"]).drop(lines)
