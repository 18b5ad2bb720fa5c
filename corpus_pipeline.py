"""The corpus pipeline: five operators in a row, each reading what the one before it wrote.

Every stage takes all rows that its predecessor kept and returns the columns of ``documents``, but for the last one, which
returns each row's shard. A document that the mix repeats stays repeated, so ids recur from there on.

Defined results, for all stages: a null in any column stays null; columns beyond those of ``documents`` are kept to the last stage but one,
whatever their names; very long texts are read whole; an empty table gives an empty one. What a stage does with null and empty texts, ties and
repeated rows is told with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontamination, minhash, mixing, quality_classifier, sharding
from tessella.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts score as the labels' share says, so they stay unless most labelled documents are bad; a score at the limit stays;
    repeated rows are judged alike and stay repeated.
    """
    return quality_classifier.accepted_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays.

    The one with the least id; null and empty texts are duplicates of nothing and stay; of rows that repeat id and text one stays; rows with a null
    id go if their group has an id.
    """
    return minhash.one_of_each(docs, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Null and empty texts leak nothing and stay; repeated rows go or stay together.
    """
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: documents are repeated, or left out beyond a source's target.

    Rows without words count nothing and go with their block; a null source is one source; repeated rows are separate documents.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and slot.

    Null texts have size 1; equal texts lie together unless they are more than a small part of a shard; repeated rows are separate records.
    """
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality), ("minhash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate),
    ("mixing sources", mix), ("sharding", shard)]

#: No stage but the last has a SQL form; the tests hold each one against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
