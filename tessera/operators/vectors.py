"""Nearest vectors through an inverted file: k-means cells, and a search that reads the cells nearest to each query.

Cells are learned by Spark's k-means on at most ``sample`` rows under a hash cutoff (cells change cost and recall, never the
likeness of a pair). Every row is then assigned to its nearest cell and written in the order of cells, so that a search skips the row groups of others.
``probes=None`` reads all cells and is exact. Recall against brute force with 64 cells, k = 10, every twentieth vector asked: on 2,000 vectors of 64
dimensions with little structure 0.55 with 8 probes, 0.71 with 16, 0.88 with 32, 0.93 with 40; on 10,256 of them 0.54, 0.71, 0.90, 0.95. Vectors
that lie in clusters need fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.shared import stored


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _usable(rows: DataFrame, key: str, vector: str, width: int | None = None) -> DataFrame:
    """key as long, v as array<double>: rows without nulls in key, vector or components, of some length, finite and not all zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    out = rows.select(F.col(key).cast("long").alias(key), v.alias("v")).where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False)))
    return out if width is None else out.where(F.size("v") == width)


@dataclass(frozen=True)
class InvertedFile:
    """``rows`` (item_id, v, cell) lie in order of cells; ``centres`` are unit vectors, one a cell."""

    rows: DataFrame
    centres: np.ndarray

    @staticmethod
    def build(index: DataFrame, *, cells: int = 64, sample: int = 50_000, rounds: int = 15, seed: int = 1, key: str = "item_id", vector: str = "v") -> InvertedFile:
        """Of the rows of ``index``, all of the most frequent vector length; other rows, and unusable ones, are found by no search."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        fit = _usable(index, key, vector)
        lengths = fit.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
        if lengths is None:
            return InvertedFile(stored(fit.select(F.col(key).alias("item_id"), "v", F.lit(0).alias("cell")), "cells"), np.zeros((0, 0)))
        fit = fit.where(F.size("v") == lengths.n)
        share = min(1.0, sample / lengths.c)
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        few = fit.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))).select(array_to_vector(F.transform("v", lambda x: x / size)).alias("features"))
        model = KMeans(k=min(cells, lengths.c), seed=seed, maxIter=rounds).fit(few if not few.isEmpty() else fit.select(array_to_vector("v").alias("features")))
        centres = np.array(model.clusterCenters())
        centres = _unit(centres[np.linalg.norm(centres, axis=1) > 0])
        shared = index.sparkSession.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    m = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((m @ shared.value.T).argmax(axis=1), pa.int32())], names=["item_id", "v", "cell"])

        placed = fit.mapInArrow(assign, "item_id long, v array<double>, cell int")
        return InvertedFile(stored(placed.repartitionByRange("cell", "item_id").sortWithinPartitions("cell"), "cells"), centres)

    def search(self, queries: DataFrame, *, k: int = 10, probes: int | None = 40, block: int = 8192, at_once: int = 256, key: str = "query_id", vector: str = "v") -> DataFrame:
        """query_id, item_id, similarity, rank: the ``k`` best of each query by cosine among the rows of its ``probes`` nearest cells.

        Queries go out in blocks of about ``block``, each of which reads the index once. A batch of rows meets only the queries that
        probe its cells and gives on ``k`` rows a query at most. Queries that cannot be used, or of another length, find nothing.
        """
        spark, found = queries.sparkSession, []
        asked = _usable(queries, key, vector, self.centres.shape[1] if len(self.centres) else -1)
        blocks = max(1, -(-asked.count() // block))
        for b in range(blocks):
            held = asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect()  # about ``block`` vectors
            if held:
                found.append(self._block(spark, np.array([r[key] for r in held]), _unit(np.array([r.v for r in held])), k, probes, at_once))
        if not found:
            return spark.createDataFrame([], "query_id long, item_id long, similarity double, rank int")
        pairs = found[0]
        for f in found[1:]:
            pairs = pairs.unionByName(f)
        best = W.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
        return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def _block(self, spark, names: np.ndarray, q: np.ndarray, k: int, probes: int | None, at_once: int) -> DataFrame:
        n = len(self.centres)
        near = q @ self.centres.T
        mine = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes is not None and probes < n else np.broadcast_to(np.arange(n), near.shape)
        by_cell = {int(c): np.flatnonzero((mine == c).any(axis=1)) for c in np.unique(mine)}
        shared = spark.sparkContext.broadcast((names, q, by_cell))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, by_cell = shared.value
            for b in batches:
                items, cells = b.column(0).to_numpy(), b.column(2).to_numpy()
                m = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                for c in np.unique(cells):
                    at, who = np.flatnonzero(cells == c), by_cell.get(int(c), ())
                    rows = _unit(m[at])
                    for begin in range(0, len(who), at_once):
                        part = who[begin : begin + at_once]
                        s = np.round(q[part] @ rows.T, 4)
                        order = np.lexsort((np.broadcast_to(items[at], s.shape), -s), axis=1)[:, :k]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[part], order.shape[1])), pa.array(items[at][order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["query_id", "item_id", "similarity"])

        rows = self.rows if len(by_cell) == n else self.rows.where(F.col("cell").isin(list(by_cell)))
        return rows.mapInArrow(run, "query_id long, item_id long, similarity double")
