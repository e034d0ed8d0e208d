"""A training corpus from ``documents``: five stages, each one operator of ``cardloom.llm``.

Each stage takes (spark, docs, folder), with ``docs`` as the stage before left
them, and returns a DataFrame that is written and read again before the next.
"""

from pyspark.sql import DataFrame, SparkSession

from cardloom.llm import copies, language, mixing, packing, toxicity
from cardloom.llm.common import table
from cardloom.session import checkpointed, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the string-kernel machine predicts toxic go."""
    ship_package(spark)
    return toxicity.clean(docs, table(spark, folder, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a letter, or without one language ahead of the others, go."""
    ship_package(spark)
    return language.accepted(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays.

    SimHash fingerprints within two bits, and shared keys of minima for what
    differs in more, give the candidates; five-word Jaccard similarity of 0.8
    or more decides.
    """
    ship_package(spark)
    return copies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mix of sources: a row for each copy taken, in service order; texts are whole, a copy that the budget would cut is left out."""
    ship_package(spark)
    return mixing.mixed(mixing.fair_queue(docs, whole=True))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", known_language),
    ("simhash", one_of_each),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None
"""Trained models and tokens are not SQL; the pipeline is tested against a brute-force version."""


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if at == 0 else checkpointed(docs), folder)
    return docs
