"""Where queries register themselves with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``, by doc_id over all cores where the table is small.

    Up to two splits a core the row groups decide who works, often one task alone; one shuffle of so little text is cheaper than its regexes
    in few tasks, and later windows by doc_id reuse it. A split goes to four tasks at least. A larger table is read as it lies.
    """
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    splits = docs.rdd.getNumPartitions()
    return docs.repartition(max(cores, 4 * splits), "doc_id") if splits <= 2 * cores else docs
