"""What several operators need: tables in the shared folder, and places in a global order without one task for all rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read again, so that lineage ends and lost executors cost nothing.

    Without the setting a temporary folder is taken where the session runs on one machine; on a cluster that is an error.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, *order: Column, name: str = "place", with_total: bool = False) -> DataFrame:
    """Adds ``name``: the row's place, from 1, in the whole ``order``; ``with_total`` adds ``total``, the number of rows.

    Rows go to range partitions, are numbered inside each (two levels: a partition's rows in blocks, so that no window holds them all),
    and the counts of earlier ranges, one row a range, are added. Rows that are equal in ``order`` have some order among them: end it
    in a unique column. Null keys stand where ``order`` puts them; an empty table gives an empty table.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not order:
        raise ValueError("an order is needed")
    # the id holds the range in its high bits and the row's number inside it in the low 33: sorted partitions are numbered as they lie
    laid = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    area = F.shiftright("_at", 33)
    counts = laid.groupBy(area.alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = counts.select("_range", before.alias("_before"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("total"))
    out = laid.withColumn("_range", area).join(F.broadcast(starts), "_range")
    out = out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_range", "_before")
    return out if with_total else out.drop("total")


def ordered_distinct(rows: DataFrame, keys: list[str], value: Column, position: Column, name: str) -> DataFrame:
    """``keys``, ``name``: the distinct values of each key in the order of their first positions; nulls are left out.

    Values are made distinct before they are listed, with map-side combine, so a list holds each value once however many rows there are.
    """
    first = rows.select(*keys, value.alias("_v"), position.alias("_p")).where("_v is not null").groupBy(*keys, "_v").agg(F.min("_p").alias("_p"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda x: x["_v"]).alias(name))
