"""A bounded labelled sample, and a ridge logistic fit on its few features: the supervised part that two operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import remainder, stored


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int, folds: int = 5) -> DataFrame:
    """``text, y, half`` of at most ``per_class`` documents of each class, in stored form.

    Only rows whose crc32(doc_id) modulo ``folds`` is not 0 are drawn, in the order of a hash of their id; ``half`` (0 or 1)
    splits them for fitting and calibration. Null labels or ids are not drawn. A cutoff of the hash, from the number of labels, goes first,
    so that what is sorted is bounded too; by chance it may leave a few less than ``per_class``.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(folds) != 0))
    n = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rank = F.pmod(F.xxhash64(F.lit(label), "doc_id"), F.lit(1 << 40))
    cut = {y: int(min(1.0, 1.2 * per_class / max(1, n.get(y, 0))) * (1 << 40)) for y in (0, 1)}
    drawn = [usable.where((F.col("y") == y) & (rank < cut[y])).orderBy(rank, "doc_id").limit(per_class) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1]).dropDuplicates(["doc_id"])  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.col("text").isNotNull())
    return stored(rows.select("text", "y", (F.xxhash64(F.lit("half"), "doc_id").bitwiseAND(1)).cast("int").alias("half")), "sample")


class Logistic:
    """P(y = 1) from features; without both classes it answers the smoothed base rate."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2):
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.rate = (y.sum() + 1) / (len(y) + 2)
        self.w = None
        if len(y) and 0 < y.sum() < len(y):
            self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
            z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
            w = np.zeros(z.shape[1])
            penalty = np.diag([1e-6] + [ridge * len(y) / 100] * (len(w) - 1))
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
                w += step
                if np.abs(step).max() < 1e-8:
                    break
            self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        if self.w is None or not len(x):
            return np.full(len(x), self.rate)
        z = self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
