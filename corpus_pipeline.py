"""The corpus pipeline: language ID, quality rules, near-copies, packing.

Each stage is an operator of ``assayframe.llm`` over all rows that its predecessor kept; its result is written to the
shared folder and read back before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm import langid, packing, quality, simhash
from assayframe.llm.common import release, staged
from assayframe.llm.queries import WORD_BPE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known by a near enough centroid."""
    return langid.keep(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base conditions and the learned decision list keep."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, WORD_BPE)


STAGES = [("language", language), ("quality", rules), ("near_copies", near_copies), ("packing", pack)]

#: Learned stages and fingerprints have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept = staged(stage(spark, docs, sf_dir), name)
        release(docs)  # a stage's table is read by the next one only
        docs = kept
    return docs
