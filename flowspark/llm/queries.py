"""Registered queries of the corpus operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import langid, linededup, lmscore, mixing, neardup, packing, pii, quality, sharding, vafile


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def op1_vafile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = lmscore.score(docs, fold(7) != 2)
    return scored.withColumn("held_out", fold(7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, fold(5) != 0)
    return langid.predict(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    runs = F.array_join(F.transform("lines.keep_runs", lambda r: F.concat_ws("+", r["start"], r["length"])), ",")
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept"), 256).alias("kept_sha256"), runs.alias("keep_runs"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(documents(spark, sf_dir), words=3, percent=85)


def op7_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(documents(spark, sf_dir), shards=8)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words",
                         "quality.base_failed", "quality.kept", "quality.lost_ratio")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_vafile_topk, op2_lm_score, op3_temperature_mix, op4_language_id, op5_line_dedup, op6_near_dup, op7_ring_sharding, op8_vector_packing, op9_pii_anchors, op10_quality_rules)
}



def _with_patterns(sql: str) -> str:
    for name in ("marks", "separators", "shouts", "links", "ending", "furniture", "boilerplate"):
        sql = sql.replace("{" + name + "}", getattr(quality, name.upper()))
    return sql


ORACLE_SQL: dict[str, str] = {
    "op1_vafile_topk": r"""
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id query_id, c.vec_id vec_id, list_inner_product(q.e, c.e)::bigint score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
        r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int rank, vec_id, score from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op5_line_dedup": r"""
        with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents),
        k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
        f as (select key, max(doc_id) home from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
        d as (select k.doc_id, k.pos, k.line, f.key is not null and k.doc_id <> f.home as gone from k left join f using (key)),
        e as (select *, gone <> coalesce(lag(gone) over (partition by doc_id order by pos), true) as turn from d),
        g as (select *, sum(turn::int) over (partition by doc_id order by pos) as run from e),
        runs as (select doc_id, string_agg((p - 1)::varchar || '+' || n::varchar, ',' order by p) keep_runs
                 from (select doc_id, run, min(pos) p, count(*) n from g where not gone group by 1, 2) group by 1)
        select doc_id, count(*) n_lines, sum(gone::int)::bigint n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) kept_sha256, coalesce(max(keep_runs), '') keep_runs
        from d left join runs using (doc_id) group by doc_id""",
    "op6_near_dup": r"""
        with recursive t as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from t),
        n as (select doc_id, count(*) n from s group by 1),
        p as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        r(a, b) as (select doc_id, doc_id from t union select r.a, l.b from r join l on r.b = l.a)
        select t.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(r.b) component_id, t.doc_id = min(r.b) kept
        from t join r on r.a = t.doc_id left join n on n.doc_id = t.doc_id group by t.doc_id""",
    "op10_quality_rules": _with_patterns(r"""
        with t as (select doc_id, coalesce(text, '') text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        g as (select doc_id, unnest(range(1, len(w) - 3)) i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) g from t),
        f as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) n from g) where n > 1),
        r as (select doc_id, sum(least(5, next - i)) n from (select *, coalesce(lead(i) over (partition by doc_id order by i), i + 5) next from f) group by 1),
        a as (select doc_id, unnest(string_split(text, chr(10))) line from t),
        b as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) words, len(regexp_extract_all(line, '{marks}')) marks, len(regexp_extract_all(line, '{separators}')) menus,
                     len(regexp_extract_all(line, '{shouts}')) shouts, len(regexp_extract_all(line, '{links}')) links,
                     len(regexp_extract_all(line, '{ending}')) endings
              from a where regexp_matches(line, '[^\x20\x09-\x0D]')),
        c as (select *, (words >= 8 and endings * 100 < words) or (words >= 4 and marks > 0.3::double * words) or (menus >= 3 and menus * 5 >= words) or links * 2 >= words
                     or (words >= 8 and shouts > 0.5::double * words) or (length(line) <= 200 and (regexp_matches(line, '{furniture}') or regexp_matches(line, '{boilerplate}'))) bad from b),
        d as (select doc_id, count(*) - count(distinct line) dup, sum(length(line)) chars, coalesce(sum(length(line)) filter (where not bad), 0) good from c group by 1),
        e as (select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols,
                     coalesce(dup, 0)::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words, coalesce(1 - good::double / chars::double, 0.0::double) lost_ratio
              from t left join r using (doc_id) left join d using (doc_id)),
        x as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from e)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and lost_ratio <= 0.5 kept, lost_ratio from x"""),
}
