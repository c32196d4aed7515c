"""The corpus pipeline: quality rules, toxicity, near-duplicates, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept, written as Parquet and read again. All stages but the last return the
columns of documents; the mix repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import mixing, packing, quality_rules, simhash, toxicity
from gradeloom.llm.common import cut
from gradeloom.llm.queries import WORD_BPE, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; learns from the labels of the documents it is given."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a similarity of 0.8 of five-word shingles joins: SimHash groups, checked exactly, then an exact search among what they leave apart; no such pair is left out."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix repeats it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(docs, WORD_BPE)


STAGES = [("quality rules", good), ("toxicity", clean), ("near-duplicates", single), ("source mix", mix), ("packing", pack)]
#: Classifier, near-duplicates and tokenizer can't be expressed in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
