"""A training corpus from raw documents to token ids: stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, jaccard, mixing, pii, quality
from textloom.llm.queries import table, tokenizer_file
from textloom.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are common to a host go, and documents that the quality rules reject.

    Null, empty and blank texts are rejected. Repeated rows share a verdict; an empty table stays empty.
    """
    return quality.without_common_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: a Jaccard similarity of 0.8 or more by shingles of five words.

    SimHash fingerprints find close copies and rare shingles the others. Of a group the smallest id stays, a null id
    only where all are null; of repeated rows one stays. Texts without words are one group.
    """
    return jaccard.one_of_each(docs, shingle=5, above=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; all documents stay, also repeated rows and those with a null text."""
    return pii.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of training, repeated or left out so that sources meet their targets.

    A null source is a source; documents without words are in no source's demand and go. Repeated rows count each.
    """
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of the ids and of the text decoded from them. A null text has no ids."""
    return bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]

#: SQL can't express the near-duplicate groups and the encoder; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each of which reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
