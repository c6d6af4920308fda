"""The registered queries of this folder and the oracle texts of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstate.llm import decontaminate, language, packing, pii, quality, secrets, simhash, topk, toxicity, warc
from keelstate.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.fit(secrets.labelled_findings(spark)))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return records.withColumn("block", F.col("block").cast("string")).withColumn("headers", F.to_json("headers"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), pii.train())


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % topk.QUERY_STEP == 0)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_topk": op9_topk,
    "op10_pii": op10_pii,
}

ORACLES = {
    "op1_decontamination": r"""
        with d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
        bw as (
            select distinct item_id, least(8, len(w)) as n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') as win
            from (select item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) as i from b where len(w) > 0)),
        lens as (select distinct n from bw),
        dw as (
            select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
            from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
        hits as (select doc_id, item_id, dw.n, i from dw join bw on dw.win = bw.win and dw.n = bw.n),
        pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
        its as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as s
                from (select distinct doc_id, item_id from hits) group by doc_id)
        select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(s, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
        from d left join pos using (doc_id) left join its using (doc_id)""",
    "op9_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
            where vec_id is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.vec_id as query_id, c.vec_id as vec_id,
                   list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
            from v q, v c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, rank::int as rank, vec_id, score from r where rank <= 10""",
}
