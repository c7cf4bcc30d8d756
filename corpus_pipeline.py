"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's docs.  All stages but the last return
the columns of ``documents``.

Defined results: a null text counts as empty and fails the quality rules; a null id or
source is a value of its own; identical rows stay or go together until near-dedup, which
treats them as copies; very long texts are whole in every stage; an empty table gives an
empty result; extra columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import lines, minhash, mixing, packing, quality_rules
from spanloom.llm.common import Work, documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    return quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without near-duplicate lines; emptied documents go."""
    return lines.dedup_lines(docs, drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixture),
    ("packing", packed),
]

#: Consistent sampling, cube sampling and tokens have no SQL; a test works every stage out by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what lies between them is written to the shared folder, and goes when it has been used."""
    work, docs = Work(spark, "pipeline"), documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = work.write(docs, small=0)
            work.drop(before)
    return docs
