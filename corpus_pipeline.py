"""A training corpus in five stages: quality, near copies, benchmark leaks, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridfold.llm import decontaminate, markov, neighbours, packing, shingles
from gridfold.llm.base import ship, table
from gridfold.llm.queries import tokenizer_path
from gridfold.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours vote for; the others go."""
    ship(spark)
    return neighbours.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    SimHash groups and MinHash bands name the pairs; five-word similarity of 0.8 or more decides.
    """
    ship(spark)
    return shingles.drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    ship(spark)
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return markov.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their training sequence and offset."""
    ship(spark)
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("secrets", secrets), ("packing", packed)]
#: Votes of neighbours and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
