"""A training corpus from documents: language ID, exact and near-duplicate removal, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), reads all that its predecessor kept, and returns the rows that stay with the columns
of documents; the last returns doc_id, n_tokens, ids and the digest of the decoded bytes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.staging import discard, scope, staged
from colscope.llm import bpe, exact_dedup, language, mixing, simhash

VOCABULARY = "byte_bpe_50k.tiktoken"
#: One epoch, so that a document comes once; four fifths of the tokens, shared out by the weights.
RECIPE = mixing.Recipe(numerator=4, denominator=5, epochs=1)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't recognised go."""
    return language.recognised(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays."""
    return simhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of the token budget stays."""
    return mixing.mixed(docs, RECIPE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language_id), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mix), ("byte-level BPE", encode)]
ORACLE_SQL = None  # SQL has neither the fingerprints nor the merges


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written before the next, and what it staged on its way, and its predecessor, are then removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scope() as kept:
            made = staged(stage(spark, docs, sf_dir))
            kept.append(made)
        discard(docs)
        docs = made
    return docs
