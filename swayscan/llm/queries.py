"""Registered queries of the operators in this subpackage: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swayscan.llm import (
    bpe, bytebpe, html_text, langid, merkle, mix, neighbours, secret_scan, simhash, topk, toxicity, warc, whitening,
)
from swayscan.llm.tables import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op2_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.93)


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(encoded).withColumnRenamed("id", "doc_id")


@query
def op9_simhash_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, limit=4)
    return found.withColumnRenamed("id", "doc_id")


def _held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 4 == 2


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~_held_out()))
    found = langid.identify(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "bits")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(_table(spark, sf_dir, "documents"))
    return secret_scan.digests(found).withColumnRenamed("id", "doc_id")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs.filter(~_held_out()), _table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", _held_out().alias("held_out"), "score", "predicted", "spans")


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = warc.read(warc.write(pages), pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "_mix.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("probability", "weight")})


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(chosen, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    found = merkle.manifest(_table(spark, sf_dir, "documents"), tampered)
    proof = merkle.proof_digest(F.col("path")).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bytebpe.encode(_table(spark, sf_dir, "documents"), path, pattern)
    return bytebpe.digests(bytebpe.decode(encoded, path, pattern)).withColumnRenamed("id", "doc_id")


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
