"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmosaic.llm.byte_bpe import encode_and_decode
from jobmosaic.llm.co_training import keep_good
from jobmosaic.llm.exact_dedup import drop_exact_copies
from jobmosaic.llm.shared import stored
from jobmosaic.llm.simhash import drop_near_copies
from jobmosaic.llm.source_mix import apply_mix

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the least doc_id stays."""
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by a similarity of 0.8 or more in five-word shingles, the one with the least doc_id stays."""
    return drop_near_copies(docs, words=5, similarity=0.8)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix leaves out go; one that it takes twice is there twice."""
    return apply_mix(docs, weights=(5, 2, 1), share=1.5, cap=2)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to."""
    decoded = encode_and_decode(docs, VOCABULARY, PATTERN)
    return decoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("source mix", mix_stage),
    ("byte-level bpe", bpe_stage),
]

#: Fingerprints, the classifier and BPE are beyond SQL; tests/llm/test_pipeline.py tells the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
