"""From raw documents to tokens: language, near copies, secrets, mixture, byte-pair encoding."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swayscan.llm import bpe, langid, mix, secret_scan, simhash
from swayscan.llm.tables import ship, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that are in no language: null, empty or without letters."""
    ship(spark)
    return langid.accepted(docs, langid.learn(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: that of the smallest id, a null id last; among rows of one id that of the least digest.

    Rows are told apart by all their columns, so rows that share an id but not a group each count in their own.
    """
    ship(spark)
    digest = F.md5(F.to_json(F.struct(*docs.columns)))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", digest.alias("digest"))
    groups = simhash.near_duplicates(docs.select(key.alias("key"), "text"), id_col="key", shingle=4, limit=4)
    kept = written(groups.filter("id.digest = component_id.digest").select("id.digest").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest.alias("digest"))  # names of columns cannot clash
    return rows.join(kept, "digest", "left_semi").dropDuplicates(["digest"]).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hide secrets; every document stays."""
    ship(spark)
    hidden = docs.withColumn("text", secret_scan.hidden("text"))
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop and repeat documents so that the tokens of sources, languages and topics meet their target shares."""
    return mix.repeated(mix.mixed(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, decode it again, and return the digests of both."""
    ship(spark)
    return bpe.digests(bpe.encode(docs, TOKENIZER)).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens),
]

#: A language model, hashes of shingles and byte-pair merges are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
