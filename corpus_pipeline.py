"""From raw documents to a mixed, encoded corpus, in five stages.

Every stage is a function of (spark, docs, sf_dir) and works on all rows that the stage before it kept. Its
result is written as Parquet and read again as the next one's input. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harvestlens.llm import byte_bpe, common, exact_dedup, mixing, near_dedup, quality
from harvestlens.session import cut, tune

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is usual for their language."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts, the one with the smallest doc_id."""
    return near_dedup.drop_similar(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document taken several times is repeated."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of token ids, and of the bytes they decode to, for each document of the mix."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN,
                           ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources", mixed),
    ("byte-level BPE", encoded),
]

ORACLE_SQL = None  # perplexity and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; returns the rows of the last."""
    docs = common.table(tune(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
