"""Language-model scores by deleted interpolation of word n-gram estimates.

The model mixes the maximum-likelihood estimates of a word given the word before it, of the word alone, and
a uniform one. The weights depend on how often the context was seen (one bucket per power of two) and are
learned by expectation-maximisation on the counts of training documents that were held out of the counts.

Counting over all text without a row per token: documents are put in blocks of a few MB. A block sends the
sorted distinct hashes of its words and word pairs with counts, cut by hash range, as compressed vectors; a
range adds up what all blocks sent and answers each with the totals, in the order asked. Vectors grow with
the text, the number of Spark rows does not, and frequent words weigh no more than rare ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import document_words, mix64, save, text_bytes

#: Bytes of text in a block (a longer document is a block of its own), and text bytes per hash range.
BLOCK = 10 << 20
RANGE = 6 << 20
#: Fixed value: the hash of the token that ends every document. It is also the first word's context.
END = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0x2545F4914F6CDD1D)
#: Counts held out of training, as a share of the training documents: one in this many.
DELETED = 8


def _squeeze(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _expand(blob: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _keys_out(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _keys_in(blob: bytes) -> np.ndarray:
    return np.cumsum(_expand(blob, np.uint64), dtype=np.uint64)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, one after the other, each with its end token; and tokens of each text."""
    words, n = document_words(texts)
    sizes = n + 1
    out = np.empty(len(words) + len(texts), np.uint64)
    ends = np.cumsum(sizes) - 1
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[ends] = END
    out[~is_end] = words
    return out, sizes


def pairs(token: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; a text's first word follows an end token."""
    before = np.concatenate((np.array([END]), token[:-1]))
    return mix64(before * _PAIR + token)


def _blocks(docs: DataFrame, learn: Column) -> DataFrame:
    """(block, deleted, ids, roles, texts): compressed blocks of whole documents. Roles: 0 scored only, 1 counted,
    2 held out of the first count. Held-out documents have blocks of their own (``deleted``)."""
    role = F.when(~learn, 0).when(F.pmod(F.xxhash64(F.lit("deleted"), "doc_id"), F.lit(DELETED)) == 0, 2).otherwise(1)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        count = 0
        open_: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def close(deleted: bool):
            nonlocal count
            ids, roles, texts = zip(*open_[deleted], strict=True)
            open_[deleted], size[deleted] = [], 0
            lengths = np.array([len(t) for t in texts], np.int64)
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            count += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([first + count]), pa.array([deleted]), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([bytes(roles)], pa.binary()),
                 pa.array([lengths.tobytes()], pa.binary()), pa.array([blob], pa.binary()), pa.array([int(lengths.sum())])],
                names=["block", "deleted", "ids", "roles", "lengths", "texts", "size"])

        for batch in batches:
            for i, r, t in zip(batch.column("doc_id").to_pylist(), batch.column("role").to_pylist(), text_bytes(batch.column("text")), strict=True):
                deleted = r == 2
                if open_[deleted] and size[deleted] + len(t) > BLOCK:
                    yield close(deleted)
                open_[deleted].append((i, r, t))
                size[deleted] += len(t) + 16
        for deleted in (False, True):
            if open_[deleted]:
                yield close(deleted)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), role.alias("role"), "text").mapInArrow(
        run, "block long, deleted boolean, ids array<long>, roles binary, lengths binary, texts binary, size long")


def _texts(row: dict) -> list[bytes]:
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(row["texts"])
    ends = np.cumsum(np.frombuffer(row["lengths"], np.int64))
    return [whole[e - n:e] for e, n in zip(ends.tolist(), np.frombuffer(row["lengths"], np.int64).tolist(), strict=True)]


def _asked(row: dict) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """A block's tokens, tokens per text, (distinct keys, place of each token) for words and pairs, roles."""
    token, sizes = tokens(_texts(row))
    roles = np.repeat(np.frombuffer(row["roles"], np.uint8), sizes)
    return token, sizes, [np.unique(x, return_inverse=True) for x in (token, pairs(token))], roles


def _requests(blocks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                _, _, asked, roles = _asked(row)
                for kind, (keys, place) in enumerate(asked):
                    counted = np.bincount(place, roles > 0, len(keys)).astype(np.uint32)
                    kept = np.bincount(place, roles == 1, len(keys)).astype(np.uint32)
                    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
                    spans = list(zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True))
                    found = [(b, a, e) for b, (a, e) in enumerate(spans) if e > a]
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b for b, _, _ in found], pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
                         *(pa.array([f(x[a:e]) for _, a, e in found], pa.binary()) for f, x in ((_keys_out, keys), (_squeeze, counted), (_squeeze, kept)))],
                        names=["range", "block", "kind", "keys", "counted", "kept"])

    return blocks.mapInArrow(run, "range int, block long, kind int, keys binary, counted binary, kept binary")


def _answer(table):
    """One hash range: totals of each key over all blocks, given back to each block in its own order."""
    import pyarrow as pa

    out = []
    sums = np.zeros(4)
    for kind in (0, 1):
        rows = [r for r in table.to_pylist() if r["kind"] == kind]
        if not rows:
            continue
        keys = [_keys_in(r["keys"]) for r in rows]
        cuts = np.cumsum([len(k) for k in keys])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        totals = [np.bincount(place, np.concatenate([_expand(r[c], np.uint32) for r in rows]), len(distinct)).astype(np.uint64) for c in ("counted", "kept")]
        if kind == 0:
            sums = np.array([totals[0].sum(), (totals[0] > 0).sum(), totals[1].sum(), (totals[1] > 0).sum()], float)
        for r, part in zip(rows, np.split(place, cuts[:-1]), strict=True):
            out.append((r["block"], r["range"], kind, _squeeze(totals[0][part]), _squeeze(totals[1][part]), None))
    out.append((-1, int(table.column("range")[0].as_py()), 0, b"", b"", sums.tolist()))
    names = ["block", "range", "kind", "counted", "kept", "sums"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _looked_up(left, right, column: str) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block with its totals: row, tokens per text, roles, and for each token the counts of the pair, of the
    context and of the word."""
    row = left.to_pylist()[0]
    token, sizes, asked, roles = _asked(row)
    answers = sorted(((r["kind"], r["range"], r[column]) for r in right.select(["kind", "range", column]).to_pylist()), key=lambda x: x[:2])
    word, pair = (np.concatenate([_expand(b, np.uint64) for k, _, b in answers if k == kind]).astype(np.int64)[asked[kind][1]] for kind in (0, 1))
    end = word[sizes[0] - 1]
    context = np.concatenate(([end], word[:-1]))
    return row, sizes, roles, pair, context, word


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of the binary logarithm of its count."""
    return np.frexp(context.astype(np.float64))[1]


def _held_out(left, right, n: float, v: float):
    """What expectation-maximisation needs from one block of held-out documents: tokens summed over a bounded
    grid of (bucket, half octaves of the pair's and the word's estimate), with the sums of their logarithms."""
    import pyarrow as pa

    _, _, _, pair, context, word = _looked_up(left, right, "kept")
    with np.errstate(divide="ignore", invalid="ignore"):
        two = np.where(pair > 0, np.log(pair / np.maximum(context, 1)), np.nan)
        one = np.where(word > 0, np.log(word / max(n, 1)), np.nan)
    cell = [np.where(np.isnan(x), -1, np.floor(-x * (2 / np.log(2)))).astype(np.int64) for x in (two, one)]
    code = (bucket(context).astype(np.int64) << 32) | ((cell[0] + 1) << 16) | (cell[1] + 1)
    codes, place = np.unique(code, return_inverse=True)
    sums = [np.bincount(place, x, len(codes)) for x in (np.ones(len(code)), np.nan_to_num(two), np.nan_to_num(one))]
    return pa.Table.from_arrays([pa.array(codes), *(pa.array(s) for s in sums)], names=["code", "n", "two", "one"])


def learn_weights(cells: list[tuple[int, float, float, float]], uniform: float, rounds: int = 100) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket, by expectation-maximisation over held-out counts given as
    (code, tokens, sum of log pair estimates, sum of log word estimates). A bucket without counts takes those of
    the nearest bucket below that has some; the uniform part keeps at least a millionth. Below the first bucket with
    counts, unseen contexts take (0, 0.9, 0.1) and seen ones (0.4, 0.5, 0.1): so do all without held-out text."""
    out = np.zeros((66, 3))
    previous = np.array([0.0, 0.9, 0.1])
    by_bucket: dict[int, list] = {}
    for code, n, two, one in cells:
        by_bucket.setdefault(code >> 32, []).append((n, np.exp(two / n) if (code >> 16) & 0xFFFF else 0.0, np.exp(one / n) if code & 0xFFFF else 0.0))
    for k in range(len(out)):
        if rows := by_bucket.get(k):
            data = np.array(rows)
            p = np.column_stack([data[:, 1], data[:, 2], np.full(len(data), uniform)])
            w = np.full(3, 1 / 3)
            for _ in range(rounds):
                share = p * w
                share *= (data[:, 0] / share.sum(axis=1))[:, None]
                fresh = share.sum(axis=0) / data[:, 0].sum()
                if np.abs(fresh - w).max() < 1e-7:
                    break
                w = fresh
            w = np.maximum(w, [0, 0, 1e-6])
            previous = w / w.sum()
        elif k == 1 and not by_bucket.get(0):
            previous = np.array([0.4, 0.5, 0.1])
        out[k] = previous
    return out


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row, from its whole text.

    The model learns from the rows for which ``learn`` holds. Tokens: words with A-Z lower-cased, then an end.
    ``base_score`` is the log10 probability with one added to each word's count; ``score`` that of the
    interpolated model; ``n_known`` the tokens seen in training.

    Null text is empty (an end token only). A null ``learn`` counts as false. Without training text all
    probability is uniform. Repeated rows are counted and scored one by one; other columns are left out; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = save(_blocks(docs, F.coalesce(learn, F.lit(False))), "lm-blocks", compression="none")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / RANGE)))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 4)
    asked = _requests(blocks, bits).repartition(parts, "range")
    answers = save(asked.groupBy("range").applyInArrow(_answer, "block long, range int, kind int, counted binary, kept binary, sums array<double>"), "lm-counts", compression="none")
    n, v, n_kept, v_kept = (x or 0.0 for x in answers.filter("block = -1").agg(*[F.sum(F.col("sums")[i]) for i in range(4)]).first())

    asked_of = answers.filter("block >= 0")
    kept = asked_of.select("block", "range", "kind", "kept")
    out = (blocks.filter("deleted").groupBy("block").cogroup(kept.join(blocks.filter("deleted").select("block"), "block", "left_semi").groupBy("block"))
           .applyInArrow(lambda left, right: _held_out(left, right, n_kept, v_kept), "code long, n double, two double, one double"))
    cells = out.groupBy("code").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one")).orderBy("code").collect()  # bounded by the grid
    weights = learn_weights([tuple(c) for c in cells], 1 / (v_kept + 1))

    def run(left, right):
        import pyarrow as pa

        row, sizes, _, pair, context, word = _looked_up(left, right, "counted")
        w = weights[np.minimum(bucket(context), len(weights) - 1)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1)
        if n == 0:
            p = np.ones(len(word))
        heads = np.cumsum(sizes) - sizes
        base = np.log10((word + 1) / (n + v + 1))
        columns = [pa.array(row["ids"], pa.int64()), pa.array(sizes), pa.array(np.add.reduceat((word > 0).astype(np.int64), heads)), pa.array(np.full(len(sizes), int(n))),
                   pa.array(np.add.reduceat(base, heads)), pa.array(np.add.reduceat(np.log10(p), heads))]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    counted = asked_of.select("block", "range", "kind", "counted")
    return blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
