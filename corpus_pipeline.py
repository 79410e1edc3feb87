"""Corpus pipeline: raw documents to packed training batches.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept. All but the last return the columns of
``docs``; the last returns doc_id with its bucket, batch and slot. SQL cannot express the trained stages, so ORACLE_SQL is
None and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, near_copies, packing, quality_rules, token_counts, toxicity
from tessera.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go."""
    return quality_rules.drop_by_rules(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; links join texts whose five-word windows have an exact Jaccard similarity of 0.8 or more."""
    return near_copies.keep_one(docs, similarity=0.8, shingle=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left gets its length bucket, batch and slot."""
    lengths = token_counts.token_counts(docs).select("doc_id", "n_tokens")
    return packing.pack(stored(lengths, "lengths"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_by_rules), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack_batches)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
