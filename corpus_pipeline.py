"""A cleaning pipeline over ``documents``: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bedside.llm import jaccard_join, mixing, piece_scan, quality_rules, suffix_dedup
from bedside.llm.common import Scratch, table

#: Bytes of a repeated passage, about 35 words: passages of 50 words and more are well above it.
REPEATED = 200


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return quality_rules.filter_quality(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents (five-word shingles, Jaccard 0.75): the one with the smallest id."""
    return jaccard_join.keep_one_per_group(docs, Scratch(spark))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of ``REPEATED`` bytes that come more than once."""
    return suffix_dedup.remove_repeats(docs, Scratch(spark), length=REPEATED)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling draws it."""
    return mixing.mixed_rows(docs, Scratch(spark))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_same`` of each document."""
    return piece_scan.encoded_and_checked(docs, piece_scan.default_model(), Scratch(spark))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: The last stage is no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage_{number}")
        if number:
            scratch.drop(f"stage_{number - 1}")
    return docs
