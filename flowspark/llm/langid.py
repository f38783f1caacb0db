"""Language identification by nearest centroid over normalised TF-IDF character n-grams.

Features are hashed byte n-grams (one to three bytes) of the lower-cased text with everything but letters
folded to one space. All labelled documents give the inverse document frequencies; a bounded sample of
them gives, by spherical k-means, several centroids per language. Every whole text is then compared by cosine; a text
too far from its nearest centroid is flagged as rejected.

Languages may be many: each is clustered in a task of its own, and centroids are broadcast in groups of languages.
With one group, rows are answered where they are read; with more, a text's best answers of all groups are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import by_bytes, save

#: Documented bound of the fit: labelled documents per language for the centroids.
SAMPLE = 400
#: Languages whose centroids are broadcast together (64 KB each).
GROUP = 400
#: Fixed value: hashed features.
FEATURES = 1 << 12

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def counts(texts: list[str]) -> np.ndarray:
    """Square roots of the n-gram counts of each text: a row of FEATURES float32 each, letters only."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        data = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
        gap = data == 32
        data = data[~(gap & np.concatenate(([False], gap[:-1])))].astype(np.uint32)
        row = np.zeros(FEATURES, np.int64)
        for at in range(0, len(data), 1 << 20):
            x = data[max(0, at - 2):at + (1 << 20)]
            if len(x) < 3:
                continue
            two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
            three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)
            for h in (x * np.uint32(0x165667B1), two, three):
                row += np.bincount(h >> np.uint32(20), minlength=FEATURES)
        out[i] = np.sqrt(row)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def cluster(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means with farthest-first starts, deterministic for a given order of rows."""
    mean = unit(x.mean(axis=0))
    centroids = x[[int((x @ mean).argmax())]]
    while len(centroids) < min(k, len(x)):
        nearest = (x @ centroids.T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        centroids = np.concatenate([centroids, x[[int(nearest.argmin())]]])
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        fresh = np.stack([unit(x[own == j].sum(axis=0)) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        if np.allclose(fresh, centroids):
            break
        centroids = fresh
    return centroids


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows of ``texts`` (column text, not null) and, by feature, of those that have it."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            rows = batch.column("text").to_pylist()
            for at in range(0, len(rows), 512):
                total[:FEATURES] += (counts(rows[at:at + 512]) > 0).sum(axis=0)
            total[FEATURES] += len(rows)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["feature", "n"])

    total = np.zeros(FEATURES + 1, np.int64)
    for r in texts.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # at most FEATURES + 1 rows
        total[r["feature"]] = r["n"]
    return int(total[FEATURES]), total[:FEATURES]


@dataclass(frozen=True)
class Model:
    """Inverse document frequencies of the features, and the centroids as a table (lang, part, centroid)."""

    idf: np.ndarray
    centroids: DataFrame
    languages: int

    def groups(self) -> Iterator[tuple[list[str], np.ndarray]]:
        """The languages in groups of about ``GROUP``: the language of each centroid, in order, and the centroids."""
        n = math.ceil(self.languages / GROUP)
        for g in range(n):
            rows = self.centroids.filter(F.pmod(F.xxhash64("lang"), F.lit(n)) == g).orderBy("lang", "part").collect()  # about GROUP languages
            if rows:
                yield [r["lang"] for r in rows], np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows])


def fit(docs: DataFrame, learn: Column, per_language: int = SAMPLE, clusters: int = 4) -> Model | None:
    """A model of ``docs`` (doc_id, text, lang): document frequencies from all rows with a language and a letter for
    which ``learn`` holds, and up to ``clusters`` centroids of each language from ``per_language`` of them at most, those
    with the lowest hashes of doc_id and text.

    Null texts, texts without a letter, null languages and rows for which ``learn`` is null take no part. Repeated
    rows count for the frequencies one by one, and once for the centroids. Other columns are left out, whatever their
    names. None if there is nothing to learn from.
    """
    ready = docs.filter(F.coalesce(learn, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    usable = ready.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "text")
    n, frequencies = document_frequencies(usable)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + frequencies)).astype(np.float32) + 0.1
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    keys = save(usable.select("lang", "h", "t").distinct().withColumn("rank", rank).filter(F.col("rank") <= per_language).drop("rank"), "lang-sample")

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in by_bytes(texts, 1 << 22):
                x = unit(counts(texts[part]) * idf)
                taken = [batch.column(c).slice(part.start, part.stop - part.start) for c in ("lang", "h", "t")]
                yield pa.RecordBatch.from_arrays([*taken, pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "h", "t", "v"])

    def clustered(sample):
        import pyarrow as pa

        sample = sample.sort_by([("h", "ascending"), ("t", "ascending")])
        found = cluster(np.frombuffer(b"".join(sample.column("v").to_pylist()), np.float32).reshape(-1, FEATURES), clusters)
        lang = sample.column("lang")[0].as_py()
        return pa.Table.from_arrays([pa.array([lang] * len(found)), pa.array(range(len(found)), pa.int32()), pa.array([c.astype(np.float32).tobytes() for c in found], pa.binary())], names=["lang", "part", "centroid"])

    # Of rows that share all of language, doc_id and text one is taken, so a task sees ``per_language`` vectors at most.
    sample = usable.join(keys, ["lang", "h", "t"], "left_semi").mapInArrow(vectors, "lang string, h long, t long, v binary")
    sample = sample.groupBy("lang", "h", "t").agg(F.min("v").alias("v"))
    centroids = save(sample.groupBy("lang").applyInArrow(clustered, "lang string, part int, centroid binary"), "centroids")
    return Model(idf, centroids, centroids.select("lang").distinct().count())


def _compared(texts: list[str | None], idf: np.ndarray, langs: np.ndarray, code: np.ndarray, weighted: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Of each text, the language of the nearest centroid (null without a letter), its cosine, and that of the best
    other language (-1 if there is none)."""
    best, top, other = [], [], []
    for at in range(0, len(texts), 512):
        few = texts[at:at + 512]
        known = np.array([t is not None and has_letter(t) for t in few])
        names, first, second = np.full(len(few), None, object), np.zeros(len(few)), np.full(len(few), -1.0)
        if known.any():
            x = counts([t for t, k in zip(few, known, strict=True) if k])
            cosine = x @ weighted / np.maximum(np.linalg.norm(x * idf, axis=1, keepdims=True), 1e-12)
            by_lang = np.stack([cosine[:, code == j].max(axis=1) for j in range(len(langs))], axis=1)
            own = by_lang.argmax(axis=1)
            names[known], first[known] = langs[own], by_lang[np.arange(len(own)), own]
            by_lang[np.arange(len(own)), own] = -1
            second[known] = by_lang.max(axis=1)
        best += names.tolist()
        top.append(first)
        other.append(second)
    return best, np.concatenate(top) if top else np.zeros(0), np.concatenate(other) if other else np.zeros(0)


def _nearest(docs: DataFrame, keep: list[str], idf: np.ndarray, names: list[str], centroids: np.ndarray) -> DataFrame:
    """``keep`` and (best, top, other) of each row of ``docs``, among the languages of one group."""
    shared = docs.sparkSession.sparkContext.broadcast((names, centroids))  # GROUP languages, about

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        langs, code = np.unique(np.array(shared.value[0], object).astype(str), return_inverse=True)
        weighted = (shared.value[1] * idf).T.astype(np.float32)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [_compared(texts[part], idf, langs, code, weighted) for part in by_bytes([t or "" for t in texts], 1 << 21)]
            best, top, other = zip(*found, strict=True) if found else ([], [np.zeros(0)], [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x for b in best for x in b], pa.string()), pa.array(np.concatenate(top)), pa.array(np.concatenate(other))],
                                             names=[*keep, "best", "top", "other"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(keep).schema)
    return docs.mapInArrow(run, f"{kinds}, best string, top double, other double")


def predict(docs: DataFrame, model: Model | None, min_score: float = 0.35) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) for each row, from its whole text.

    ``score`` is the cosine with the nearest centroid (0 to 1), ``margin`` its lead over the best other
    language, ``rejected`` whether the score is below ``min_score`` or there is no letter. Null text and text
    without a letter: ``und``, score 0, rejected. Without a model all are ``und``. Repeated rows get equal
    answers; other columns are left out; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = model.groups() if model else iter(())
    first, second = next(groups, None), next(groups, None)
    if first is None:
        found = rows.select("doc_id", F.lit(None).cast("string").alias("best"), F.lit(0.0).alias("top"), F.lit(-1.0).alias("other"))
    elif second is None:
        found = _nearest(rows, ["doc_id"], model.idf, *first)
    else:
        # The answer hangs on the text alone, which two hashes name.
        named = rows.select("doc_id", "text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("lang"), "text").alias("b"))
        merged = None
        for group in (first, second, *groups):
            part = save(_nearest(named, ["a", "b"], model.idf, *group).filter("best is not null").groupBy("a", "b").agg(F.min(F.struct("best", "top", "other")).alias("x")), "lang-group")
            merged = part if merged is None else merged.unionByName(part)
        lead = F.array_sort(F.collect_list(F.struct((-F.col("x.top")).alias("less"), F.col("x.best").alias("best"), F.col("x.other").alias("other"))))  # one a group
        merged = merged.groupBy("a", "b").agg(lead.alias("all")).select(
            "a", "b", F.col("all")[0]["best"].alias("best"), (-F.col("all")[0]["less"]).alias("top"),
            F.greatest(F.col("all")[0]["other"], F.coalesce(-F.get("all", F.lit(1))["less"], F.lit(-1.0))).alias("other"))
        found = named.drop("text").join(merged, ["a", "b"], "left").select("doc_id", "best", F.coalesce("top", F.lit(0.0)).alias("top"), F.coalesce("other", F.lit(-1.0)).alias("other"))
    known = F.col("best").isNotNull()
    score = F.least(F.greatest(F.col("top"), F.lit(0.0)), F.lit(1.0))
    margin = F.when(~known, 0.0).when(F.col("other") > -1, F.col("top") - F.col("other")).otherwise(F.col("top"))
    return found.select("doc_id", F.coalesce("best", F.lit("und")).alias("lang_pred"), score.alias("score"), margin.alias("margin"), (~known | (score < min_score)).alias("rejected"))
