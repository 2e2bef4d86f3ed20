"""From raw documents to the places of their tokens in training sequences: five stages, each over all that the one before kept. Every stage
takes tables without rows, null, empty and very long texts, null and repeated ids, as its operator states."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from tessera.llm.common import documents, materialise

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that 5-word shingles link at 0.8, the one with the smallest id stays."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in no order: the next stage has its own."""
    return mixing.mixed_documents(docs, in_order=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the mixed documents stands in sequences of at most 4096 tokens; its ids are told by their checksum and not kept."""
    return packing.pack(packing.token_pieces(docs, VOCABULARY, with_ids=False))


STAGES = [("quality rules", quality), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("source mixing", source_mix), ("best-fit packing", packed)]

#: SQL has no tokenizer; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
