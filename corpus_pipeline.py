"""A training-data pipeline: reject poor documents, keep one of each near-duplicate, mix the sources, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilday.functions.storage import stored
from vigilday.llm import mixing, packing, quality, simhash
from vigilday.llm.common import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and with the words, that the mix to target weights takes of them."""
    return mixing.mixed_documents(docs)


def best_two_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.MODEL))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("best_two_fit", best_two_fit),
]

#: A fitted model and hashes stand between documents and result, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``; every stage's result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
