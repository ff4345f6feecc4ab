"""From raw documents to token ids in five stages; every stage works on all rows its predecessor kept.

In all stages an empty table gives an empty table, extra columns pass through whatever their names, and texts of any length
are read whole.  Rows are what stages work on: a doc_id may be null or stand in several rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dup, mixing, near_dup, toxicity
from tidemark.session import shared_folder
from tidemark.sources.sinks import stages


def drop_toxic(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among them, does not reject.

    Null and empty texts get the score of a text without features.  Rows that repeat are scored alike; a labelled
    doc_id in several rows gives one document to the fit.  Without labels nothing is rejected.
    """
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """One document of each distinct text, the one with the largest doc_id.

    A null text counts as empty, so one of all null and empty texts stays; a null doc_id is smaller than any number.
    Of rows alike in doc_id and text one stays, chosen by a hash of the whole row.
    """
    return exact_dup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Rows without words and rows without doc_id always stay; rows that share the doc_id that stays all stay.
    """
    return near_dup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents as often as the mix takes them, none more than three times.

    A null source is a source of its own; documents without words stand as often as their source is taken whole.  Ranks tie
    only for rows alike in doc_id, and of those alike in text too as many are taken as fit.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Token ids, their number, and digests of the ids and of the text they decode to, for each row; null counts as empty."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Classifiers, sketches and tokenizers are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, directory: str) -> DataFrame:
    """The rows of the last stage over `directory`/documents.parquet; what stages write on the way goes with them."""
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, directory)
        path = f"{shared_folder(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with stages(spark):
            stage(spark, docs, directory).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
