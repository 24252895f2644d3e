"""From raw documents to packed training sequences.

1. The quality classifier, trained on the labels, rejects documents.
2. Of texts that are equal but for white space, the one with the smallest id stays.
3. Of texts linked by similar word shingles, one stays.
4. Sources are mixed to their target weights: a document leaves, stays, is repeated, or gives a part.
5. What is left is packed into windows of 4096 tokens.

Stages 1 to 4 return the columns of ``documents``; after the mix an id may occur up to three times.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scarpline.llm import exact, mixing, packing, quality, setsketch
from scarpline.llm.common import documents, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setsketch.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", mix_sources),
    ("packing", pack),
]

# Trained scores, sketches and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before it kept, written to the shared folder in between."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        out = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
