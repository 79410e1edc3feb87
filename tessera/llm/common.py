"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int, key: str = "doc_id") -> Column:
    """crc32 of the key's text modulo ``divisor``; a null key counts as remainder -1, so it is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % divisor, F.lit(-1))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Without the setting a temporary folder takes its place if the session runs on one machine; on a cluster, whose executors would
    each write to their own disks, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, columns: list[str], schema: str | T.StructType, make: Callable[[], Callable[..., dict]]) -> DataFrame:
    """Run ``make()(*lists)`` on every Arrow batch of ``columns``; it returns a dict of equally long columns of ``schema``.

    ``make`` runs once a task, so that what is costly to build is built on the executor, not per batch.
    """
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            got = step(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type, from_pandas=False) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def filter_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., object]]) -> DataFrame:
    """The rows of ``df``, with all columns, for which ``make()(*lists of columns)`` is true; one call a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            got = keep(*[batch.column(batch.schema.names.index(c)).to_pylist() for c in columns])
            yield batch.filter(pa.array([bool(x) for x in got], pa.bool_()))

    return df.mapInArrow(run, df.schema)
