"""A corpus pipeline in four stages: quality rules, exact dedup, MinHash near-dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netloom.llm.common import Work, unused
from netloom.llm.exact_dedup import drop_copies
from netloom.llm.near_dup import drop_near_duplicates
from netloom.llm.packing import pack_documents
from netloom.llm.quality_rules import features, judge, labelled_sample, learn, statistics


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rule and every learned rule; rules are learned from the labelled ones among docs.

    A null or empty text has no words and goes by the base rule; rows that repeat, and null ids, are judged each for itself.
    """
    row = unused(docs, "_row")
    rules = learn(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), list(features()))
    return judge(statistics(docs, whole=row), rules).filter("kept").select(f"{row}.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest id; of rows that repeat it, one."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; null ids and texts without words all stay."""
    return drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences; a null or empty text is its end id alone."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("packing", packed)]

#: The rules are learned and the tokens are a tokenizer's: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's result is written and read again as the next one's input.

    An empty table passes through all stages; columns beside doc_id and text are carried as they are to the last one.
    """
    work, docs = Work(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), table := name.replace(" ", "-"))
        if before:
            work.drop(before)  # its successor is written
        before = table
    return STAGES[-1][1](spark, docs, sf_dir)
