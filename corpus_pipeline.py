"""The corpus pipeline: five stages, each written and read again, from documents to token digests.

Quality rules, exact dedup, SimHash near-dedup, mixing to target weights, byte-level BPE. Each stage works
on all that the one before it kept; all but the last return the columns of documents. Every stage defines
null, empty and repeated rows in its operator's docstring; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules, simhash
from quillgraph.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality_rules.keep_good(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.keep_one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the one with the smallest doc_id: fingerprints at most two bits apart first.

    Of texts with a Jaccard similarity of 0.8 most fingerprints differ in more bits than any such search can bear, so
    of what is left those go that an earlier one is as similar to over shingles of five words.
    """
    return near_dedup.keep_no_near_copies(simhash.keep_one_of_each(docs))


def near_full(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No two documents with a Jaccard similarity of 0.8 or more over shingles of five words stay."""
    return near_dedup.keep_no_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as their source's quota takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixture), ("byte-level BPE", tokens)]
#: The same with a near-dedup that misses no pair.
FULL_STAGES = [(name, near_full if stage is near else stage) for name, stage in STAGES]
#: The learned rules, SimHash linking and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages: list = STAGES) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in stages:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def run_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, FULL_STAGES)
