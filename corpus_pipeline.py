"""A training corpus in five stages: each is stored and read again as the next one's documents.

Stages but the last return the columns of ``documents``; the last returns packed sequences. A stage
judges the rows it is given and works on all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm import packing, pii, quality, scratch, simhash, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the machine, trained on the labelled ones, predicts to be toxic go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.judged(docs, model, docs.columns).where("predicted = 0").select("row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or the limits of their language and source go."""
    return quality.judged(docs).where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked texts one stays, that of the least id. Shingle length and distance are
    those of the operator's contract."""
    return simhash.representatives(docs, width=3, max_bits=2)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by the names of its kinds."""
    masked = pii.mask(docs, pii.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in pieces, each with its training sequence and its place there."""
    import public_tokenizers

    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("quality", drop_low_quality), ("near_dedup", drop_near_duplicates),
    ("pii", hide_personal_data), ("packing", pack_sequences)]

# the stages' models and hashes have no counterpart in SQL; tests/llm hold brute-force versions
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
