"""Packing (10): optimal length buckets from the global histogram, then batches of a token budget inside each bucket.

Lengths are counted over all documents into classes (exact up to 1024, then 256 classes to every doubling, rounded up). Dynamic
programming over the classes finds the bucket boundaries with the least padding; each bucket pads to its own boundary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def length_class(n: Column) -> Column:
    """The least representative length that is at least ``n``: at most 256 classes to a doubling."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - 9).cast("long")
    step = F.when(n <= 1024, F.lit(1)).otherwise(step).cast("long")
    return (F.ceil(n / step) * step).cast("long")


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` of the ascending ``lengths`` such that padding each length up to the next boundary costs least."""
    v, c = np.array(lengths, float), np.array(counts, float)
    m = len(v)
    if not m:
        return []
    rows = np.concatenate([[0.0], np.cumsum(c)])
    best, cut = v * rows[1:], np.zeros((min(buckets, m), m), int)  # one bucket ends at i: rows up to i times v[i]
    for k in range(1, min(buckets, m)):
        now = np.empty(m)
        for i in range(m):
            # the last bucket takes classes j..i; j = 0 leaves fewer buckets
            cost = np.concatenate([[0.0], best[:i]]) + v[i] * (rows[i + 1] - rows[: i + 1])
            j = int(cost.argmin())
            now[i], cut[k, i] = cost[j], j
        best = now
    out, i, k = [], m - 1, min(buckets, m) - 1
    while i >= 0:
        out.append(int(lengths[i]))
        i, k = (cut[k, i] if k else 0) - 1, k - 1
    return out[::-1]


def boundaries_of(lengths: DataFrame, buckets: int) -> list[int]:
    """Boundaries for the column ``n_tokens``; the histogram has a bounded number of classes."""
    rows = lengths.select(length_class(F.col("n_tokens")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).orderBy("c").collect()
    return optimal_boundaries([r.c for r in rows], [r.n for r in rows], buckets)


def pack(lengths: DataFrame, *, buckets: int = 16, budget: int = 65_536, block_rows: int = 65_536) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch, slot for every row of (doc_id, n_tokens).

    A batch of bucket b holds ``max(1, budget // bucket_length)`` documents, so that ``documents * bucket_length`` is within the budget but
    for a document that is longer by itself. A null length counts as 0. Batches are numbered in each bucket from 0 without
    gaps; only the last of a bucket may be short. Repeated rows are packed each; an empty table stays empty.
    """
    rows = lengths.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    ends = boundaries_of(rows, buckets)
    if not ends:
        return rows.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_length"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    bucket = sum(((F.col("n_tokens") > e).cast("int") for e in ends[:-1]), F.lit(0))
    placed = rows.withColumn("bucket", bucket)
    # a bucket may hold a third of all rows: number its rows in blocks, each behind the ones before it
    n = placed.groupBy("bucket").agg(F.count("*").alias("n")).collect()
    blocks = F.create_map(*[F.lit(x) for r in n for x in (r.bucket, max(1, -(-r.n // block_rows) * 4))])
    blocked = placed.withColumn("block", F.pmod(F.xxhash64(F.lit("pack"), "doc_id"), F.element_at(blocks, F.col("bucket"))).cast("int"))
    sizes = blocked.groupBy("bucket", "block").agg(F.count("*").alias("n")).orderBy("bucket", "block").collect()
    start, ahead, last = [], 0, None
    for r in sizes:
        ahead = ahead if r.bucket == last else 0
        start.append((r.bucket, r.block, ahead))
        ahead, last = ahead + r.n, r.bucket
    plan = lengths.sparkSession.createDataFrame(start, "bucket int, block int, ahead long")
    joined = blocked.join(F.broadcast(plan), ["bucket", "block"])
    place = F.col("ahead") + F.row_number().over(W.partitionBy("bucket", "block").orderBy("doc_id", "n_tokens")) - 1
    length = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1)
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1)))).cast("long")
    return joined.withColumn("place", place).withColumn("bucket_length", length).withColumn("per", per).select("doc_id", "n_tokens", "bucket", "bucket_length", F.floor(F.col("place") / F.col("per")).cast("long").alias("batch"), F.pmod("place", "per").alias("slot"))
