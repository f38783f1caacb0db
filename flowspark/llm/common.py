"""Shared helpers of the corpus operators: scratch tables and vectorised word hashing.

Scratch tables live under ``spark.checkpoint.dir``, which every executor and the driver share, so a
lost executor never takes intermediate data with it. A local master without that setting (tests) gets
a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator of this package.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; raises on a cluster that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(spark, "_flowspark_scratch", None) or tempfile.mkdtemp(prefix="flowspark-")
        spark._flowspark_scratch = root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, deleted when the JVM ends at the latest."""
    path = f"{scratch_root(spark)}/flowspark/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that ``save`` made and that no result needs any more."""
    for table in tables:
        jpath = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch)
        jpath.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` (a lambda over a column)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in path; both give the same result."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), so that all bits of ``x`` reach all bits of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        if n > 4 * _CHUNK:
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the lower-cased (A-Z) words of UTF-8 ``buffer``.

    A word is a run of bytes outside ``WHITE``. Each word is a polynomial in an odd base modulo 2**64,
    taken relative to its own start, with its length mixed in; everything is vectorised over bytes.
    """
    data = np.frombuffer(buffer, np.uint8)
    hashes, starts = [], []
    at, size = 0, len(data)
    while at < size:
        end = min(at + _CHUNK, size)
        if end < size:
            cut = np.flatnonzero(_IS_SPACE[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:
                rest = np.flatnonzero(_IS_SPACE[data[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else size
        part = data[at:end]
        space = _IS_SPACE[part]
        first = ~space
        first[1:] &= space[:-1]
        begin = np.flatnonzero(first)
        if len(begin):
            power, inverse = _power_tables(max(_CHUNK, len(part)))
            value = (_LOWER[part].astype(np.uint64) + np.uint64(1)) * power[: len(part)]
            value[space] = 0
            value = np.add.reduceat(value, begin) * inverse[begin]
            length = np.add.reduceat((~space).astype(np.uint32), begin).astype(np.uint64)
            hashes.append(mix64(value ^ (length * np.uint64(0xD6E8FEB86659FD93))))
            starts.append(begin + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def document_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts in one pass, and the number of words of each text."""
    hashes, starts = word_hashes(b"\n".join(texts))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return hashes, np.diff(np.searchsorted(starts, ends, "left"), prepend=0)


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null is the empty text."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def by_bytes(texts: list[bytes], limit: int):
    """Slices of ``texts`` of about ``limit`` bytes, at least one text each."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > limit:
            yield slice(at, i)
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield slice(at, len(texts))
