"""Corpus pipeline: good documents, no exact or near copies, mixed to target weights, packed.

Each stage reads what its predecessor wrote and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relaygrid.llm.common import read
from relaygrid.llm.exact_dedup import drop_exact_copies
from relaygrid.llm.mixing import mixed_texts
from relaygrid.llm.near_dedup import drop_near_copies
from relaygrid.llm.packing import pack
from relaygrid.llm.quality import keep_good
from relaygrid.session import settle, tune


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, read(tune(spark), sf_dir, "labels"))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    tune(spark)
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    tune(spark)
    return drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix reads them: once, twice, in part or not at all."""
    tune(spark)
    return mixed_texts(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    tune(spark)
    return pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_exact_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: Learned scores, hashed minima and tokenisers are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(tune(spark), sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{place}")
    return docs
