"""The registered queries of the thirteen operators, each over its whole table at production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm import (ann, byte_bpe, filter_audit, html_text, line_dedup, packing, pii, quality,
                          sharding, simhash, toxicity, warc, whitening)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_read(spark, sf_dir, "pages"))


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), shards=24)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode(_read(spark, sf_dir, "documents"),
                           public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                           public_tokenizers.PATTERN, with_ids=False)


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.best_fit(_read(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN, with_text=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.quality(docs, keep=["doc_id"])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), width=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_shared_lines(docs, min_docs=5, min_chars=40).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_text, op2_feistel_shards, op3_toxicity, op4_byte_bpe,
                            op5_best_fit, op6_warc, op7_multi_index, op8_quality, op9_simhash,
                            op10_pii, op11_line_dedup, op12_filter_audit, op13_whitening)}

# the hashing, models and whole-text loops of the others have no counterpart in SQL; tests/llm hold
# brute-force versions
ORACLES: dict[str, str] = {"op11_line_dedup": line_dedup.ORACLE,
                           "op12_filter_audit": filter_audit.ORACLE}
