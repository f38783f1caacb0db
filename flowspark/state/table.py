"""State tables: keyed values as sorted-out Parquet segments, updated one batch at a time.

Three kinds differ in what a repeated batch does:

* non-transactional: it is applied again;
* transactional (same id, same rows): it is skipped, by the batch id stored with each key;
* opaque (same id, maybe other rows): it is applied to the value before that batch, which is stored as well.

An update writes one segment that holds the keys it touched and nothing else. Readers take a key's newest row. As
soon as ``FAN`` segments of one level have gathered they are merged into one of the next, so that a row is written
again a number of times that grows with the logarithm of the state. A version is a small file that lists segments; it
appears by one rename under a name of its own, so a crash at any point leaves the version before or the new one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.schema import require, same_key

NON_TRANSACTIONAL, TRANSACTIONAL, OPAQUE = "non-transactional", "transactional", "opaque"
#: Segments of one level that are merged into one of the next.
FAN = 8
SEQ, GONE = "__seq", "__gone"


class StateTable:
    def __init__(self, spark: SparkSession, path: str, keys: str, value: str, kind: str = OPAQUE, keep: int = 2):
        """``keys`` and ``value`` are DDL strings; ``value`` names one field. ``keep``: versions left in place. No
        keys: a single value."""
        if kind not in (NON_TRANSACTIONAL, TRANSACTIONAL, OPAQUE):
            raise ValueError(f"no such kind: {kind}")
        self.spark, self.path, self.kind, self.keep = spark, path.rstrip("/"), kind, keep
        self.key_schema = T.StructType.fromDDL(keys) if keys else T.StructType([])
        self.value_field = T.StructType.fromDDL(value)[0]
        self.keys, self.value = self.key_schema.names, self.value_field.name
        extra = {NON_TRANSACTIONAL: [], TRANSACTIONAL: [T.StructField("txid", T.LongType())],
                 OPAQUE: [T.StructField("txid", T.LongType()), T.StructField("prev", self.value_field.dataType)]}[kind]
        self.schema = T.StructType([*self.key_schema.fields, self.value_field, *extra])

        self._stored = T.StructType([*self.schema.fields, T.StructField(SEQ, T.LongType()), T.StructField(GONE, T.BooleanType())])

    # Versions

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, root = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[2:]) for n in names if re.fullmatch(r"v-[0-9]{10}", n))

    def _load(self, version: int) -> dict:
        if not version:
            return {"segments": [], "newest": None}
        fs, p = self._fs(f"{self.path}/v-{version:010d}")
        stream = self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(fs.open(p)))
        try:
            return json.loads(stream.readLine())
        finally:
            stream.close()

    def _current(self) -> tuple[int, dict]:
        version = max(self._versions(), default=0)
        return version, self._load(version)

    def _publish(self, version: int, segments: list[list], newest: int | None) -> None:
        """Make a version, by one rename; then remove versions and segments that nobody reads any more."""
        fs, tmp = self._fs(f"{self.path}/.next-{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps({"segments": segments, "newest": newest}).encode()))
        out.close()
        _, target = self._fs(f"{self.path}/v-{version:010d}")
        if fs.exists(target) or not fs.rename(tmp, target):
            raise OSError(f"version {version} exists already: there is another writer")
        self._clean()

    def _clean(self) -> None:
        versions = self._versions()
        used = {name for v in versions[-self.keep:] for name, _ in self._load(v)["segments"]}
        fs, root = self._fs(self.path)
        for version in versions[:-self.keep]:
            fs.delete(self._fs(f"{self.path}/v-{version:010d}")[1], False)
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("s-") and name not in used:
                fs.delete(status.getPath(), True)

    def _segment(self, df: DataFrame) -> str:
        name = f"s-{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._stored]).write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, df: DataFrame, epoch: int | None, alone: bool = False) -> DataFrame:
        """Write ``df`` as the newest segment, or the only one, and publish it; then merge what has gathered."""
        version, now = self._current()
        newest = max((e for e in (now["newest"], epoch) if e is not None), default=None)
        name = self._segment(df.withColumn(SEQ, F.lit(version + 1)))
        segments = [*([] if alone else now["segments"]), [name, 0]]
        self._publish(version + 1, segments, newest)
        merged = False
        while True:
            level = segments[-1][1]
            tail = [s for s in segments if s[1] == level]
            if len(tail) < FAN:
                break
            rows = self._newest_rows(tail)
            if len(tail) == len(segments):
                # A repeat of the newest batch may still ask what a removed key held before.
                rows = rows.filter(~F.col(GONE) | ((F.col("txid") == F.lit(newest)) if self.kind == OPAQUE and newest is not None else F.lit(False)))
            segments, merged = [*segments[:len(segments) - len(tail)], [self._segment(rows), level + 1]], True
        if merged:
            self._publish(version + 2, segments, newest)
        return self.spark.read.schema(self._stored).parquet(f"{self.path}/{name}")

    def _newest_rows(self, segments: Sequence[Sequence], of: DataFrame | None = None) -> DataFrame:
        """The newest stored row of each key in the segments, removed keys included; of the keys in ``of`` only, if given."""
        if not segments:
            return self.spark.createDataFrame([], self._stored)
        df = self.spark.read.schema(self._stored).parquet(*[f"{self.path}/{name}" for name, _ in segments])
        if of is not None and self.keys:
            asked = of.select(*[F.col(k).alias(f"d_{k}") for k in self.keys])
            df = df.join(asked, same_key(df, asked, [(k, f"d_{k}") for k in self.keys]), "left_semi")
        if len(segments) == 1:
            return df
        rest = [c for c in self._stored.names if c not in self.keys]
        last = F.max_by(F.struct(*rest), F.col(SEQ)).alias("last")
        out = df.groupBy(*self.keys).agg(last) if self.keys else df.agg(last).filter(F.col("last").isNotNull())
        return out.select(*self.keys, "last.*").select(*self._stored.names)

    def rows(self) -> DataFrame:
        """The whole current version: keys, value and what the kind stores besides."""
        return self._newest_rows(self._current()[1]["segments"]).filter(~F.col(GONE)).select(*self.schema.names)

    def snapshot(self) -> DataFrame:
        """(keys, value) as of the last update."""
        return self.rows().select(*self.keys, self.value)

    def get(self, keys: DataFrame) -> DataFrame:
        """(keys, value) of the keys in ``keys`` that the state has; reads no more than it needs to."""
        require(keys, self.keys)
        return self._newest_rows(self._current()[1]["segments"], keys).filter(~F.col(GONE)).select(*self.keys, self.value)

    # Updates

    def _staged(self, df: DataFrame, epoch: int | None) -> tuple[DataFrame, str]:
        """``df`` written down, so that it is computed once and its size is known."""
        newest = self._current()[1]["newest"]
        if self.kind != NON_TRANSACTIONAL and epoch is not None and newest is not None and newest > epoch:
            raise ValueError(f"batch {epoch} is older than the stored batch {newest}")
        path = f"{self.path}/.staged-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def _again(self, epoch: int | None) -> Column:
        """Whether a stored row comes from the batch ``epoch``."""
        known = self.kind != NON_TRANSACTIONAL and epoch is not None
        return F.coalesce(F.col("txid").eqNullSafe(F.lit(epoch)), F.lit(False)) if known else F.lit(False)

    def _base(self, epoch: int | None) -> Column:
        """What a batch is applied to: null if the key has no value."""
        live = F.when(~F.col(GONE), F.col(self.value))
        return F.when(self._again(epoch), F.col("prev")).otherwise(live) if self.kind == OPAQUE else live

    def _written(self, df: DataFrame, epoch: int | None) -> DataFrame:
        """Commit rows (keys, value, base); gives (keys, value)."""
        extra = {NON_TRANSACTIONAL: {}, TRANSACTIONAL: {"txid": F.lit(epoch).cast("long")}, OPAQUE: {"txid": F.lit(epoch).cast("long"), "prev": F.col("base")}}[self.kind]
        out = df.select(*self.keys, self.value, *[c.alias(n) for n, c in extra.items()], F.lit(False).alias(GONE))
        return self._commit(out, epoch).select(*self.keys, self.value)

    def _unstage(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def update(self, deltas: DataFrame, epoch: int | None, merge: Callable[[Column, Column], Column], start: Column | None = None) -> DataFrame:
        """Merge ``deltas`` (keys, value; one row a key: aggregate the batch first) and return (keys, value) of the
        keys touched. ``merge(old, delta)`` is called for keys with a value; others take the delta, or
        ``merge(start, delta)`` if a ``start`` is given. ``epoch`` numbers the batch; numbers never go down."""
        require(deltas, [*self.keys, self.value])
        staged, path = self._staged(deltas.select(*self.keys, self.value), epoch)
        old = self._newest_rows(self._current()[1]["segments"], staged)
        new = staged.select(*[F.col(k).alias(f"d_{k}") for k in self.keys], F.col(self.value).alias("delta"))
        on = same_key(old, new, [(k, f"d_{k}") for k in self.keys]) if self.keys else F.lit(True)
        both = new.join(old, on, "left")
        base = self._base(epoch)
        begin = F.col("delta") if start is None else merge(start, F.col("delta"))
        merged = F.when(base.isNull(), begin).otherwise(merge(base, F.col("delta")))
        if self.kind == TRANSACTIONAL:
            merged = F.when(self._again(epoch) & ~F.col(GONE), F.col(self.value)).otherwise(merged)
        out = self._written(both.select(*[F.col(f"d_{k}").alias(k) for k in self.keys], merged.alias(self.value), base.alias("base")), epoch)
        self._unstage(path)
        return out

    def fold(self, rows: DataFrame, epoch: int | None, function: Callable[[Any, list[dict]], Any], order: Sequence[str] = ()) -> DataFrame:
        """Update with user code: ``function(value, rows)`` gives a key's new value from the one it has (None if none)
        and the batch's rows of the key, as dicts sorted by ``order``. Rows of a key meet in one task. Returns as
        ``update`` does."""
        require(rows, [*self.keys, *order])
        staged, path = self._staged(rows, epoch)
        old = self._newest_rows(self._current()[1]["segments"], staged)
        old = old.select(*self.keys, F.col(self.value).alias("now"), self._base(epoch).alias("base"), (self._again(epoch) & ~F.col(GONE)).alias("again"))
        names, keys = list(rows.columns), self.keys or ["__all"]
        left, right = (staged, old) if self.keys else (staged.withColumn("__all", F.lit(0)), old.withColumn("__all", F.lit(0)))
        fields = [*self.key_schema.fields, self.value_field, T.StructField("base", self.value_field.dataType)]
        schema, skip = T.StructType(fields), self.kind == TRANSACTIONAL
        own = list(self.keys)

        def run(batch, stored):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            kinds = to_arrow_schema(schema)
            out = []
            if len(batch):
                found = stored.to_pylist()
                base = found[0]["base"] if found else None
                key = [batch.column(k)[0].as_py() for k in own]
                if found and skip and found[0]["again"]:
                    out.append((*key, found[0]["now"], base))
                else:
                    batch = batch.sort_by([(o, "ascending") for o in order]) if order else batch
                    out.append((*key, function(base, batch.select(names).to_pylist()), base))
            columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
            return pa.Table.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(columns)], schema=kinds)

        done = self._written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema), epoch)
        self._unstage(path)
        return done

    def put(self, values: DataFrame, epoch: int | None = None) -> DataFrame:
        """Replace the values of the keys in ``values``."""
        return self.update(values, epoch, lambda _, new: new)

    def remove(self, keys: DataFrame, epoch: int | None = None) -> None:
        """Take keys out. Under OPAQUE, a repeat of the same batch still sees them: the value is kept as ``prev``."""
        require(keys, self.keys)
        staged, path = self._staged(keys.select(*self.keys).distinct(), epoch)
        old = self._newest_rows(self._current()[1]["segments"], staged)
        none = F.lit(None).cast(self.value_field.dataType)
        extra = {NON_TRANSACTIONAL: [], TRANSACTIONAL: [F.lit(None).cast("long").alias("txid")], OPAQUE: [F.lit(epoch).cast("long").alias("txid"), self._base(epoch).alias("prev")]}[self.kind]
        self._commit(old.select(*self.keys, none.alias(self.value), *extra, F.lit(True).alias(GONE)), epoch)
        self._unstage(path)

    def keep_newest(self, n: int) -> None:
        """Bound the table to the ``n`` keys touched last (ties: smaller keys)."""
        if self.kind == NON_TRANSACTIONAL:
            raise ValueError("needs the batch ids that transactional kinds store")
        self._commit(self.rows().orderBy(F.col("txid").desc_nulls_last(), *self.keys).limit(n).withColumn(GONE, F.lit(False)), None, alone=True)

    def as_json(self) -> DataFrame:
        """(keys, json): the stored form of each kind as JSON: value, [txid, value] or [txid, value, prev]."""
        parts = {NON_TRANSACTIONAL: [self.value], TRANSACTIONAL: ["txid", self.value], OPAQUE: ["txid", self.value, "prev"]}[self.kind]
        text = [F.coalesce(F.to_json(F.array(p)), F.lit("[null]")) for p in parts]
        bare = [F.regexp_replace(t, r"^\[|\]$", "") for t in text]
        return self.rows().select(*self.keys, (bare[0] if len(bare) == 1 else F.concat(F.lit("["), F.concat_ws(",", *bare), F.lit("]"))).alias("json"))
