"""Prepares ``documents`` for training: five stages, each written and read again before the next.

Every stage works on all that the one before it kept and returns the columns of documents, but for the last, which returns
where each piece of each document goes. As what a stage returns is stored before the next one starts, a stage first deletes
the intermediate tables of the one before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from runledger.llm import mixing, near_duplicates, packing, personal_data, quality_rules
from runledger.llm.common import forget, noted, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_left: list[str] = []


def tidy(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if stage is first:
            _left.clear()  # of another run, whose result may still be read
        forget(spark, _left)
        with noted(_left):
            return stage(spark, docs, sf_dir)

    return run_stage


def reject(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.good_documents(docs)


first = reject
reject = tidy(reject)


@tidy
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_duplicates.distinct_documents(docs)


@tidy
def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    return personal_data.masked_documents(docs)


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", reject),
    ("near_duplicates", deduplicate),
    ("personal_data", mask),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

# Similarity of sketched sets, token ids and trained span models are beyond SQL: the tests hold each stage against a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = staged(docs)
    return docs
