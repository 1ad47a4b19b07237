"""Queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import bpe, conversations, embeddings, extraction, media, packing, passages, quality, resampling, secrets, simhash, suffixes, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(_table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


#: The list's source: keys of pages that some feed links to.
FEED = "%utm_source=feed%"


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(_table(spark, sf_dir, "pages"), F.col("url").like(FEED))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_and_read(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_texts(_table(spark, sf_dir, "pages"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repairs(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_passages": op3_passages,
    "op4_packing": op4_packing,
    "op5_bpe": op5_bpe,
    "op6_suffixes": op6_suffixes,
    "op7_embeddings": op7_embeddings,
    "op8_urls": op8_urls,
    "op9_media": op9_media,
    "op10_quality": op10_quality,
    "op11_resampling": op11_resampling,
    "op12_extraction": op12_extraction,
    "op13_conversations": op13_conversations,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op8_urls": f"""
        with rest as (
            select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages
        ), parts as (
            select page_id, url, regexp_extract(r, '^([^/?#]*)', 1) as h, r from rest
        ), keys as (
            select page_id, lower(h) as host, regexp_extract(substr(r, length(h) + 1), '^([^?#]*)', 1) as path, coalesce(url like '{FEED}', false) as on_list from parts
        ), listed as (
            select host || path as key, max(case when on_list and host || path <> '' then 1 else 0 end) as listed from keys group by 1
        ), ruled as (
            select page_id, host, path, listed,
                case when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
                     when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
                     when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'com/en/'
                     when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'net/de/'
                     when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'org/es/' end as rule
            from keys join listed on listed.key = keys.host || keys.path
        )
        select page_id, host, path, rule,
            case rule when 'example.com/en/7' then 'allow' when 'net/de/' then 'allow'
                      when 'com/en/' then 'block' when 'example.net/de/8' then 'block' when 'org/es/' then 'block'
                      else case when listed = 1 then 'block' else 'allow' end end as verdict
        from ruled""",
    "op11_resampling": r"""
        with crc_table as (
            select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as crc
        ), words as (
            select 0 as of, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents
            union all
            select 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark
        ), codes as (
            select w, lower(hex(encode(w))) as h from (select distinct w from words)
        ), hashed as (
            select w, xor(list_reduce(
                list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: 16 * (strpos('0123456789abcdef', h[2 * i + 1]) - 1) + strpos('0123456789abcdef', h[2 * i + 2]) - 1)),
                lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1])), 4294967295) % 10000 as bucket
            from codes, crc_table
        ), sums as (
            select bucket, count(*) filter (of = 0) as s, count(*) filter (of = 1) as t from words join hashed using (w) group by bucket
        ), totals as (
            select sum(s)::double as sa, sum(t)::double as ta from sums
        ), gains as (
            select bucket, floor(1000 * ln((t + 1)::double * (sa + 10000) / ((s + 1)::double * (ta + 10000))))::bigint as gain from sums, totals
        ), means as (
            select doc_id, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from words join hashed using (w) join gains using (bucket) where of = 0 group by doc_id
        ), noise as (
            select doc_id, list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', sha256('2024:' || doc_id)[i]) - 1), lambda a, d: 16 * a + d) as h from documents
        ), scored as (
            select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score
            from noise left join means using (doc_id)
        ), ranked as (
            select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as able from scored where n_features >= 20
        )
        select doc_id, n_features::bigint as n_features, weight, score, case when rank <= able * 10 // 100 then rank end as rank from scored left join ranked using (doc_id)""",
}
