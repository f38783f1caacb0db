"""Near-duplicate detection: MinHash bands, sequential Bayesian pruning, exact verification, components.

Texts with equal shingle sets form one node, so groups of copies cost one row. Nodes that share a band of
their signatures meet in a bucket. Within a bucket nodes are compared with one leader first (a star, linear
in the bucket), components are formed, and only pairs whose components still differ are compared afterwards,
one by one in small buckets and in blocks in large ones, which report connecting links alone; no pair of a bucket
is skipped unless a chain of confirmed links already connects it. In buckets of every size a candidate passes
batches of signature comparisons as long as the posterior probability of reaching the threshold is at least
``miss``, and what passes is confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import by_bytes, document_words, mix64, save, text_bytes

#: Signature rows in a band. The number of bands follows from the threshold and the miss probability.
ROWS = 5
#: Signature entries compared at a time.
BATCH = 20
#: Members of a bucket up to which all its pairs that are still apart are listed.
SMALL = 16
#: Nodes in a block of a family, and bytes of their shingles, about.
BLOCK = 1024
BLOCK_BYTES = 32 << 20
_STEP = np.uint64(0x9FB21C651E98DF25)


def band_count(percent: int, miss: float, rows: int = ROWS) -> int:
    """Bands needed so that a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240607))
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def least_matches(n: int, percent: int, miss: float) -> int:
    """The fewest of ``n`` matching entries with which similarity at or over the threshold still has a posterior
    probability of ``miss`` or more, from a uniform prior."""
    t, tail = percent / 100, 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``words`` words, or the whole of a shorter text."""
    w, n = document_words(texts)
    runs = w
    for j in range(1, words):
        runs = mix64(runs[:-1] * _STEP + w[j:]) if len(runs) > 1 else runs[:0]
    out, at = [], 0
    for size in n.tolist():
        if size >= words:
            found = np.sort(runs[at:at + size - words + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif size:
            h = np.uint64(size)
            for x in w[at:at + size]:
                h = mix64(np.array([h * _STEP + x], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def identity(found: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    mixed = mix64(found)
    return int(mix64(np.array([mixed.sum(dtype=np.uint64) + np.uint64(len(found)) * _STEP], np.uint64)).view(np.int64)[0])


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    x = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        low = np.minimum(low, (a[:, None] * x[None, at:at + 4096] + b[:, None]).min(axis=1))
    return low.tobytes()


def _signatures(docs: DataFrame, words: int, size: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a, b = permutations(size)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            counts, nodes, signatures = [], [], []
            for part in by_bytes(texts, 1 << 21):
                with np.errstate(over="ignore"):
                    for found in shingle_sets(texts[part], words):
                        counts.append(len(found))
                        nodes.append(identity(found) if len(found) else None)
                        signatures.append(signature(found, a, b) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())],
                                             names=["doc_id", "text_hash", "n_shingles", "node", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, sig binary")


def _pack(found: np.ndarray) -> bytes:
    import zstandard

    steps = np.diff(found >> np.uint64(16), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(6, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :6] = planes.T
    return np.cumsum(wide.view(np.uint64).reshape(-1), dtype=np.uint64)


def _sets(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """(node, shingles) for the nodes in ``need`` (node, first_doc), from the text of their first document."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, wanted = text_bytes(batch.column("text")), batch.column("node").to_pylist()
            for part in by_bytes(texts, 1 << 21):
                with np.errstate(over="ignore"):
                    rows = [(n, _pack(found)) for n, found in zip(wanted[part], shingle_sets(texts[part], words), strict=True) if len(found) and identity(found) == n]
                nodes, blobs = zip(*rows, strict=True) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("first_doc"), "text").join(need.select("first_doc", "node"), "first_doc").select("node", "text")
    return chosen.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles"))


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with ``column`` of both nodes, as x and y."""
    right = table.select(F.col("node").alias("b"), F.col(column).alias("y"))
    left = table.select(F.col("node").alias("a"), F.col(column).alias("x"))
    return pairs.join(right, "b").join(left, "a")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int, miss: float, size: int) -> DataFrame:
    """The pairs that no batch of signature entries rules out, with the share of matching entries."""
    steps = [*range(BATCH, size, BATCH), size]
    least = [least_matches(n, percent, miss) for n in steps]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, size) for c in "xy")
            live, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, m in zip(steps, least, strict=True):
                matches[live] += (x[live, done:n] == y[live, done:n]).sum(axis=1)
                live, done = live[matches[live] >= m], n
            keep = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep), pa.array(matches[live] / size)], names=["a", "b", "share"])

    return _both(pairs, nodes, "sig").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, share double")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets reach the threshold."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                p, q = _unpack(x.as_py()), _unpack(y.as_py())
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return _both(pairs, sets, "shingles").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node in ``links`` (a, b): root is the smallest node that links lead to.

    Alternates two star contractions until nothing changes; each round is a pair of partial aggregations and
    joins over a scratch table, and rounds grow with the logarithm of a component's diameter.
    """
    edges = save(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = save(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        edges = save(small.distinct(), "edges")


def _family_links(rest: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, miss: float, size: int) -> DataFrame:
    """Links (a, b) that join different roots among the members of large buckets (key, node, leader, root), exact
    and complete up to connectivity.

    Buckets that share members form a family, so a group that meets in many bands is treated once. Each member
    outside the family's largest component is compared with all members. Both sides come in blocks of about
    ``BLOCK`` nodes and ``BLOCK_BYTES``. A task compares signatures batch by batch, drops what the posterior bound rules
    out, counts the common shingles of the rest by an index over shingles, and reports only links that connect what it
    has not connected yet: fewer than it has nodes.
    """
    steps = [*range(BATCH, size, BATCH), size]
    least = [least_matches(n, percent, miss) for n in steps]
    families = components(rest.select(F.col("leader").alias("a"), F.col("node").alias("b"))).select("node", F.col("root").alias("family"))
    rows = rest.select("node", "root").distinct().join(families, "node", "left").withColumn("family", F.coalesce("family", "node"))
    rows = save(rows.join(nodes.select("node", "n_shingles"), "node"), "families")
    sizes = rows.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"), (8 * F.sum("n_shingles")).alias("bytes"))
    sizes = sizes.groupBy("family").agg(F.sum("n").alias("all"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "root", "bytes")).alias("largest"))
    blocks = lambda n, b: F.ceil(F.greatest(n / BLOCK, b / BLOCK_BYTES)).cast("int")
    sizes = sizes.select("family", F.col("largest.root").alias("main"), blocks(F.col("all"), F.col("bytes")).alias("wide"),
                         blocks(F.col("all") - F.col("largest.n"), F.col("bytes") - F.col("largest.bytes")).alias("tall")).filter("tall > 0")
    table = rows.join(sizes, "family").join(sets, "node").join(nodes.select("node", "sig"), "node")
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["family", "i", "j", "node", "root", "shingles", "sig"]
    few = table.filter("root <> main").withColumn("i", block(F.col("tall"))).withColumn("j", every(F.col("wide"))).select(columns)
    all_ = table.withColumn("j", block(F.col("wide"))).withColumn("i", every(F.col("tall"))).select(columns)

    def run(left, right):
        import pyarrow as pa

        found = [_unpack(x.as_py()) for x in right.column("shingles")]
        sizes, nodes, roots = np.array([len(f) for f in found]), right.column("node").to_pylist(), right.column("root").to_pylist()
        elements, place = np.unique(np.concatenate(found), return_inverse=True)
        owners = np.repeat(np.arange(len(found)), sizes)[np.argsort(place, kind="stable")]
        first = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(elements)))))
        signatures = np.frombuffer(b"".join(right.column("sig").to_pylist()), np.uint32).reshape(-1, size)
        ranked = np.array(roots)
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        links = []
        for node, root, blob, sig in zip(left.column("node_").to_pylist(), left.column("root_").to_pylist(), left.column("shingles_"), left.column("sig_"), strict=True):
            own = np.frombuffer(sig.as_py(), np.uint32)
            live, matches, done = np.flatnonzero(ranked != root), np.zeros(len(ranked), np.int32), 0
            for n, m in zip(steps, least, strict=True):
                matches[live] += (signatures[live, done:n] == own[done:n]).sum(axis=1, dtype=np.int32)
                live, done = live[matches[live] >= m], n
            if not len(live):
                continue
            mine = _unpack(blob.as_py())
            at = np.searchsorted(elements, mine)
            at = at[(at < len(elements)) & (elements[np.minimum(at, len(elements) - 1)] == mine)]
            common = np.zeros(len(found), np.int64)
            for a in at.tolist():
                common[owners[first[a]:first[a + 1]]] += 1
            for k in live[100 * common[live] >= percent * (len(mine) + sizes[live] - common[live])].tolist():
                x, y = top(root), top(roots[k])
                if x != y:
                    parent[x] = y
                    links.append((node, nodes[k]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["family", "i", "j"]
    few = few.toDF("f", "p", "q", "node_", "root_", "shingles_", "sig_")  # names of its own: both sides come from one table
    return few.groupBy("f", "p", "q").cogroup(all_.groupBy(*keys)).applyInArrow(lambda left, right: run(left, right) if len(left) and len(right) else _no_links(), "a long, b long")


def _no_links():
    import pyarrow as pa

    return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def _rooted(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    found = roots.select(F.col("node").alias(column), F.col("root").alias(name))
    return df.join(found, column, "left").withColumn(name, F.coalesce(name, column))


def group(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: documents linked, directly or in a chain, by a
    Jaccard similarity of their ``words``-word shingle sets of ``percent`` or more.

    ``component_id`` is the smallest doc_id in reach, the row's own included; ``kept`` whether it is the row's own.
    ``miss``: the probability with which a pair at the threshold may share no band, and the posterior probability
    below which a candidate is given up.

    Null, empty and blank texts have no shingles and no links. A null doc_id is linked with nothing, has a null
    component and is kept. Rows that share a doc_id are answered one by one; equal rows get equal answers (both
    are ``kept`` if one is). Other columns are left out; an empty table gives no rows.
    """
    return _grouped(docs, words, percent, miss).drop("text_hash")


def _grouped(docs: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """The columns of ``group`` and text_hash, a 64-bit hash of the row's text."""
    size = band_count(percent, miss) * ROWS
    sigs = save(_signatures(docs, words, size), "signatures")
    nodes = save(sigs.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles")), "nodes")

    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(size // ROWS)])
    bands = nodes.select("node", F.explode(keys).alias("key"))
    leaders = bands.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = save(bands.join(leaders.select("key", F.col("leader.node").alias("leader")), "key"), "members")

    need = nodes.select("node", "first_doc").join(members.select("node").distinct(), "node", "left_semi")
    sets = save(_sets(docs, need, words), "sets", compression="none")
    star = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = save(_likely(star, nodes, percent, miss, size), "star")
    best = star.groupBy("b").agg(F.max(F.struct("share", "a")).alias("best")).select("b", F.col("best.a").alias("a"))
    links = save(_confirmed(best, sets, percent), "links")
    roots = components(links)

    # Whatever is still apart within a bucket is compared: small buckets pair by pair, large ones by families.
    rooted = save(_rooted(members, roots, "node", "root"), "rooted")
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("key", "n")
    rest = save(rooted.join(apart, "key"), "apart")
    small = rest.filter(F.col("n") <= SMALL)
    other = small.select("key", F.col("node").alias("b"), F.col("root").alias("other"))
    cross = small.select("key", F.col("node").alias("a"), "root").join(other, "key").filter("a < b and root <> other").select("a", "b").distinct()
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = save(_likely(cross.join(tried, ["a", "b"], "left_anti"), nodes, percent, miss, size), "cross").select("a", "b")
    more = _confirmed(cross, sets, percent).unionByName(_family_links(rest.filter(F.col("n") > SMALL), nodes, sets, percent, miss, size))
    roots = components(links.unionByName(save(more, "links")))

    placed = _rooted(nodes.select("node", "first_doc"), roots, "node", "root")
    least = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    answer = save(placed.join(least, "root").select("node", "component_id"), "answer")
    out = sigs.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(answer, "node", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """``docs`` with one document left of each group of near duplicates; rows that share a doc_id but not the text
    stay or go one by one."""
    gone = _grouped(docs, words, percent, miss).filter("not kept").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")
