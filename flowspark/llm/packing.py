"""Vector bin packing of tokenised documents under limits on tokens, segments and loss-bearing tokens.

Texts are tokenised and cut where they are read; only lengths and checksums travel. A document of several lines
is taken as instruction data: its first line is the prompt, which bears no loss, all other tokens bear it. Pieces
are dealt by hash into groups of a bounded expected size and each group is packed greedily: the open sequence
takes the piece with the largest dot product of its demands and the room that is left.
"""

from __future__ import annotations

import math
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import fresh, save, text_bytes

#: Expected number of pieces in a group that is packed together.
GROUP = 2000
#: Limits of a sequence: tokens, pieces (a bound on the attention mask's blocks) and loss-bearing tokens (so that
#: no sequence weighs much more than others in the loss).
MAX_TOKENS = 4096
MAX_SEGMENTS = 16
MAX_LOSS = 4032
_CACHE_ENTRIES = 250_000
_encoders: dict[str, Callable[[bytes], bytes]] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _remember(cache: dict, old: dict, key, value) -> None:
    """Keep two generations: what was used lately survives, and no more than twice ``_CACHE_ENTRIES`` are held."""
    if len(cache) >= _CACHE_ENTRIES:
        old.clear()
        old.update(cache)
        cache.clear()
    cache[key] = value


def by_runs(spec: dict) -> str | None:
    """The split pattern of a tokenizer whose ids of a text are those of its runs between white space, one after the
    other; None for any other layout."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec.get("model") or {}
    plain = steps == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    dealt = [p.get("type") for p in pre] == ["Split", "ByteLevel"] and pre[0].get("invert") and pre[0].get("behavior") == "Removed" and "Regex" in pre[0].get("pattern", {})
    if not (plain and dealt) or pre[1].get("use_regex") or pre[1].get("add_prefix_space") or model.get("type") != "BPE" or model.get("dropout"):
        return None
    import regex

    pattern = pre[0]["pattern"]["Regex"]
    looks_around = regex.search(r"\(\?|\\[bBAZzG]|(?<![\[\\])\^|\$", pattern)
    return None if looks_around or any(regex.search(pattern, c) for c in map(chr, range(0x3001)) if regex.match(r"\p{White_Space}", c)) else pattern


def word_encoder(path: str) -> Callable[[bytes], bytes]:
    """Text to little-endian 32-bit ids, equal to the tokenizer's own encoding without special tokens.

    For tokenizers as in ``by_runs``, runs are encoded once and kept in a bounded cache; a text with what might be a
    special token, or with characters that interact across runs, is encoded whole. With any other tokenizer all
    texts are encoded whole.
    """
    if path in _encoders:
        return _encoders[path]
    import json

    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path) as f:
        spec = json.load(f)
    if sys.byteorder != "little" or array("I").itemsize != 4:
        raise RuntimeError("needs little-endian 32-bit integers")
    if (pattern := by_runs(spec)) is None:
        _encoders[path] = lambda text: np.asarray(tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return _encoders[path]
    split = regex.compile(pattern)
    special = [t["content"].encode() for t in spec["added_tokens"]]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    shown = [shown[b] for b in range(256)]
    plain = regex.compile(r"[\t-\r\x20-\x7e¡-įı-ɏ]*")
    model, pieces, old_pieces = tokenizer.model, {}, {}
    cache, old_cache = {}, {}

    def whole(text: str) -> bytes:
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece_ids(piece: str) -> bytes:
        if (got := pieces.get(piece)) is None:
            if (got := old_pieces.get(piece)) is None:
                form = piece if piece.isascii() else "".join([shown[b] for b in piece.encode()])
                got = array("I", [t.id for t in model.tokenize(form)]).tobytes()
            _remember(pieces, old_pieces, piece, got)
        return got

    def run_ids(run: bytes) -> bytes:
        if (got := old_cache.get(run)) is None:
            text = run.decode()
            word, mark = (text[:-1], text[-1]) if text[-1] in ".,;:!?" else (text, "")
            if word.isalpha() and (word.isascii() or plain.fullmatch(word)):
                got = piece_ids(word.lower()) + (piece_ids(mark) if mark else b"")
            else:
                got = b"".join([piece_ids(p) for p in split.findall(text.lower())]) if plain.fullmatch(text) else whole(text)
        _remember(cache, old_cache, run, got)
        return got

    def encode(text: bytes) -> bytes:
        if any(s in text for s in special) or not text.isascii() and not unicodedata.is_normalized("NFC", text.decode()):
            return whole(text.decode())
        get = cache.get
        return b"".join([x if (x := get(run)) is not None else run_ids(run) for run in text.split()])

    _encoders[path] = encode
    return encode


def pack_vectors(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each row of ``demands``, so that no bin's column sums exceed ``limits``.

    Bins are filled one after the other. Each takes, among the rows that fit, the one with the largest dot
    product with the room left (both as shares of the limits), ties to the larger and then the earlier row.
    """
    share = demands / limits
    order = np.lexsort((np.arange(len(demands)), *(-share.T[::-1])))
    share, need = share[order], demands[order]
    bins, order_left = np.full(len(demands), -1, np.int64), np.arange(len(demands))
    if (demands > limits).any():
        raise ValueError("a demand exceeds the limits")
    full = limits.astype(np.int64)
    room, current, placed = full.copy(), 0, np.zeros(len(demands), bool)
    while len(need):
        fits = (need <= room).all(axis=1) & ~placed
        if not fits.any():
            room, current = full.copy(), current + 1
            keep = ~placed
            share, need, order_left, placed = share[keep], need[keep], order_left[keep], placed[keep]
            continue
        best = int(np.where(fits, share @ (room / limits), -1.0).argmax())
        bins[order_left[best]], placed[best] = current, True
        room -= need[best]
    out = np.empty_like(bins)
    out[order] = bins
    return out


def cut_points(n: int, prompt: int, max_tokens: int, max_loss: int) -> list[tuple[int, int, int]]:
    """(start, length, loss) of the pieces of ``n`` tokens of which the first ``prompt`` bear no loss."""
    out, at = [], 0
    while at < n:
        length = min(max_tokens, max(0, prompt - at) + max_loss, n - at)
        out.append((at, length, length - min(length, max(0, prompt - at))))
        at += length
    return out


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int, max_loss: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, loss_tokens) of each piece of each text."""
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, end = word_encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple[int, int, int, int, int, int]] = []
            for i, text in enumerate(text_bytes(batch.column("text"))):
                first, newline, rest = text.partition(b"\n")
                ids = encode(first)
                prompt = len(ids) // 4 if newline else 0
                ids += encode(rest) + end
                n = len(ids) // 4
                rows += [(i, at, length, zlib.crc32(ids[4 * at:4 * (at + length)]), n, loss) for at, length, loss in cut_points(n, prompt, max_tokens, max_loss)]
            who, *columns = zip(*rows, strict=True) if rows else [()] * 6
            taken = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(taken), *(pa.array(c, pa.int64()) for c in columns)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long")


def pack_pieces(pieces: DataFrame, max_tokens: int, max_segments: int, max_loss: int, loss: Column | None = None) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (at least doc_id, start, length). ``loss``: loss-bearing tokens
    of a piece, else its loss_tokens, or its length. Each sequence has at most the given tokens, segments and loss.

    Which pieces are packed together hangs on their columns alone: equal rows are counted first and then numbered,
    so that they spread over the groups however many there are.
    """
    bears = loss if loss is not None else F.col("loss_tokens") if "loss_tokens" in pieces.columns else F.col("length")
    pieces = pieces.withColumn("loss_tokens", bears.cast("long"))
    copies, number = fresh(pieces, "copies"), fresh(pieces, "group")
    table = save(pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias(copies)), "pieces")
    groups = max(1, math.ceil((table.agg(F.sum(copies)).first()[0] or 0) / GROUP))
    limits = np.array([max_tokens, max_segments, max_loss], np.int64)

    def pack(group):
        import pyarrow as pa

        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")])
        length = group.column("length").to_numpy()
        demands = np.stack([length, np.ones(len(length), np.int64), group.column("loss_tokens").to_numpy()], axis=1)
        bins = pack_vectors(demands, limits)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        firsts = np.searchsorted(bins[order], bins[order], "left")
        offset = np.empty_like(length)
        offset[order] = ends - length[order] - (ends[firsts] - length[order][firsts])
        numbers = group.column(number).to_numpy().astype(np.int64)
        return (group.append_column("sequence_id", pa.array(numbers * (1 << 24) + bins)).append_column("offset", pa.array(offset)).drop_columns([number]))

    dealt = table.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), copies))).withColumn(number, F.pmod(F.xxhash64(*table.columns), F.lit(groups))).drop(copies)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy(number).applyInArrow(pack, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None) -> DataFrame:
    """Pieces of all documents with their place in a sequence: doc_id, start, length, ids_crc32, doc_tokens,
    loss_tokens, sequence_id, offset.

    A document is its tokenizer ids and ``end_id``. If it has several lines, the first is its prompt and bears no
    loss. It is cut where a piece would exceed ``max_tokens`` ids or ``max_loss`` loss-bearing ones (63/64 of the
    tokens unless given); each id lies in exactly one piece. Offsets within a sequence leave no gap.

    Null or empty text is the end id alone. A null doc_id stays null. Repeated rows are packed one by one. Other
    columns are left out; an empty table gives no rows.
    """
    max_loss = max_loss or max(1, max_tokens * MAX_LOSS // MAX_TOKENS)
    return pack_pieces(tokenised(docs, tokenizer or default_tokenizer(), end_id, max_tokens, max_loss), max_tokens, max_segments, max_loss)
