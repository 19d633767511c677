"""Cleaning documents for training: toxicity, language, near-duplicates, benchmark leaks, then token ids.

Each stage reads what its predecessor kept; models learn from the labelled rows of the whole documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe, decontaminate, language_id, simhash, toxicity
from quillgraph.llm._tables import Cut, scope, table
from quillgraph.llm.queries import TOXIC


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, name="_score").where(f"_score < {TOXIC}").drop("_score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose languages are too close to tell, go."""
    dicts = language_id.train(table(spark, sf_dir, "documents"))
    return language_id.judged(docs, dicts, names=("_lang", "_p", "_accepted")).where("_accepted").drop("_lang", "_p", "_accepted")


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that with the smallest id."""
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("simhash_neardup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", encoding_stage),
]

#: Hashes, compression and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope() as cuts:
            kept = Cut(stage(spark, docs, sf_dir), name)
            cuts.remove(kept)
        if before:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
