"""Queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_main, langid, packing, quality, resample, sharding, simhash, sql, tokenfile, turns, urls, warc
from .common import staged

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Verdicts of hosts with their subdomains and of paths below them; pages that they fit are the labelled outcomes.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 24)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), WORD_BPE)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(_table(spark, sf_dir, "documents"), WORD_BPE)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica in which the records of one residue class had bytes changed where they lie."""
    held = F.when(F.col("page_id") % 97 == 13, F.replace("record", F.lit("e"), F.lit("3"))).otherwise(F.col("record"))
    both = staged(warc.index(_table(spark, sf_dir, "pages"), other=held), "warc")
    return warc.audit(both.drop("other"), both.drop("digest").withColumnRenamed("other", "digest")).selectExpr(
        "file", "part", "page_id", "offset AS record_offset", "length AS record_length", "digest", "corrupt"
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(turns.damage(_table(spark, sf_dir, "conversations")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed=2024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_sharding, op2_packing, op3_token_files, op4_simhash, op5_html,
            op6_quality, op7_warc, op8_bpe, op9_language, op10_neighbours,
            op11_url_filter, op12_repair, op13_resampling,
        )
    }


_ID = "md5(page_id || '|' || coalesce(url, '') || '|' || coalesce(html, ''))"
_LINE = "chr(13) || chr(10)"
_RECORD = (
    f"'WARC/1.1' || {_LINE} || 'WARC-Type: resource' || {_LINE} || 'WARC-Record-ID: <urn:uuid:' || substr({_ID}, 1, 8) || '-' || substr({_ID}, 9, 4) || '-' || "
    f"substr({_ID}, 13, 4) || '-' || substr({_ID}, 17, 4) || '-' || substr({_ID}, 21) || '>' || {_LINE} || 'WARC-Date: {warc.NO_DATE}' || {_LINE} || 'WARC-Target-URI: ' || "
    f"coalesce(url, '') || {_LINE} || 'Content-Type: text/html' || {_LINE} || 'Content-Length: ' || coalesce(strlen(html), 0) || {_LINE} || {_LINE} || coalesce(html, '') || {_LINE} || {_LINE}"
)


def oracle_sql() -> dict[str, str]:
    return {
        "op7_warc": f"""
            WITH r AS (SELECT page_id, url, coalesce(CAST(floor(page_id / 512.0) AS BIGINT), -1) AS file, {_RECORD} AS a FROM pages),
                 h AS (SELECT file, page_id, url, strlen(a) AS record_length, sha256(a) AS digest, coalesce(page_id % 97 = 13, false) AS corrupt FROM r)
            SELECT file, CAST(0 AS INT) AS part, page_id,
                   CAST(sum(record_length) OVER (PARTITION BY file ORDER BY page_id, url, digest
                        ROWS UNBOUNDED PRECEDING) - record_length AS BIGINT) AS record_offset,
                   CAST(record_length AS BIGINT) AS record_length, digest, corrupt
            FROM h
        """,
        "op11_url_filter": sql.url_filter(URL_RULES, urls.SUFFIXES, 0.5, 1.645),
        "op12_repair": sql.conversations(),
        "op13_resampling": sql.resampling(10, 20, 2024, resample.BUCKETS),
    }
