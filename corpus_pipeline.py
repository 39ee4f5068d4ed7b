"""A corpus in stages: each takes what the one before kept, and its decisions take effect.

Documents without text, id, host and so on are handled as the operators say. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontaminate, host_rules, line_dedup, packing, superminhash
from riskloom.llm.columns import tidy
from riskloom.session import materialise, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, of hosts that pass."""
    return host_rules.passing(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stand earlier; those that keep no word go."""
    return line_dedup.deduplicate_lines(docs, drop_emptied=True)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return superminhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold little of the benchmark, without long passages of it."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _stage(f):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(prepare(spark))
        return f(spark, docs, sf_dir)

    return run_stage


STAGES = [
    (name, _stage(f))
    for name, f in (
        ("quality_rules", quality_rules),
        ("line_dedup", line_deduplication),
        ("near_dedup", near_deduplication),
        ("decontamination", decontamination),
        ("packing", sequence_packing),
    )
]

#: Near duplicates and token ids are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows stored before the next begins."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
