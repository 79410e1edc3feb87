"""Hard-negative mining (11): a full sort of every anchor's integer scores, read from each positive's score downwards.

The rows are written once as whole-number vectors; anchors go out in broadcast blocks of ``anchor_block``, and every task scores its
rows against them in pieces of ``rows_block`` rows. One pass finds each anchor's positives among the rows of its label, a second
one sorts all scores by (score, id), binary-searches each positive's upper and lower limit and reads the first ``k`` rows of other
labels between them. A piece gives on at most ``positives`` rows, or ``positives * k``, for an anchor, so what is merged is a small part of
the scores; neither an anchor nor a label is a shuffle key of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Scores of one step are held at once: anchors of a step times rows of a piece.
SCORES_AT_ONCE = 1 << 21
EXACT = float(1 << 53)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long; null where the vector or a component is null or not finite."""
    x = vector.cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(vector.isNotNull() & fit, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def _scores(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole-number inner products: by doubles where no partial sum can leave their exact range, else by 64-bit integers."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(rows).max(initial=0)) * a.shape[1]
    if reach < EXACT:
        return (a.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return a @ rows.T


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """width -> (ids in ascending order, labels, vectors) of up to ``size`` rows at a time; equal rows once."""
    held: list[pa.RecordBatch] = []

    def made() -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        t = pa.Table.from_batches(held)
        ids, labels = (t.column(i).to_numpy() for i in (0, 1))
        vectors = t.column(2).combine_chunks()
        widths, flat = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
        begin, out = np.cumsum(widths) - widths, {}
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            v = flat[begin[at][:, None] + np.arange(w)]
            order = np.lexsort((*v.T, labels[at], ids[at]))
            i, y, v = ids[at][order], labels[at][order], v[order]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (y[1:] != y[:-1]) | (v[1:] != v[:-1]).any(axis=1)
            out[int(w)] = (i[new], y[new], v[new])
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, size):
            held.append(batch.slice(at, size))
            if sum(b.num_rows for b in held) >= size:
                yield made()
                held.clear()
    if held:
        yield made()


def _batch(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)


def hard_negatives(rows: DataFrame, anchor: Column, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, k: int = 5, lower: int = 80, upper: int = 100, anchor_block: int = 16_384, rows_block: int = 65_536) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where ``anchor`` holds. Scores are inner products of floor(``scale`` * component); higher ones come first, ties by
    the smaller key. An anchor's positives are the first ``positives`` rows of its label with another key; for each, the first ``k``
    rows of other labels with ``lower * positive_score <= 100 * negative_score <= upper * positive_score`` are returned (``upper`` at most 100).

    Rows with a null key, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths do
    not meet. Equal rows count once; different rows under one key are rows of their own. Arithmetic is that of 64-bit integers. An empty
    table, or one without anchors, gives an empty table. Other columns are not looked at whatever their names. The driver holds one
    block of anchors with its positives at a time.
    """
    spark = rows.sparkSession
    fit = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("y"), whole(F.col(vector), scale).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor")).where("id is not null and y is not null and v is not null")
    parts = max(2 * spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    fit = stored(fit.repartition(parts, "id", "v"), "vectors")
    anchors = fit.where("anchor").select("id", "y", "v").distinct()
    blocks = max(1, -(-anchors.count() // anchor_block))
    found = []
    for b in range(blocks):
        held = sorted((r.id, r.y, r.v) for r in anchors.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b).collect())  # about ``anchor_block`` rows
        if held:
            found.append(_mine(fit, held, positives, k, lower, upper, rows_block))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _mine(fit: DataFrame, held: list[tuple], positives: int, k: int, lower: int, upper: int, rows_block: int) -> DataFrame:
    spark = fit.sparkSession
    asked = {}  # width -> places in ``held``, ids, labels, vectors
    for w in sorted({len(h[2]) for h in held}):
        at = [i for i, h in enumerate(held) if len(h[2]) == w]
        asked[w] = (np.array(at), np.array([held[i][0] for i in at]), np.array([held[i][1] for i in at]), np.array([held[i][2] for i in at], np.int64).reshape(len(at), w))
    shared = spark.sparkContext.broadcast(asked)

    def scored(batches: Iterator[pa.RecordBatch]):
        """place, id and label of an anchor, then ids, labels and scores of a piece of rows, in ascending order of ids."""
        for piece in _pieces(batches, rows_block):
            for w, (ids, labels, vectors) in piece.items():
                if w not in shared.value or not len(ids):
                    continue
                places, names, kinds, a = shared.value[w]
                step = max(1, SCORES_AT_ONCE // len(ids))
                for begin in range(0, len(a), step):
                    s = _scores(a[begin : begin + step], vectors)
                    for j in range(len(s)):
                        yield places[begin + j], names[begin + j], kinds[begin + j], ids, labels, s[j]
                yield None  # the piece is done

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], []]
        for got in scored(batches):
            if got is None:
                if out[0]:
                    yield _batch(out, ["place", "positive_id", "positive_score"])
                out = [[], [], []]
                continue
            place, name, kind, ids, labels, s = got
            at = np.flatnonzero((labels == kind) & (ids != name))
            order = at[np.lexsort((ids[at], -s[at]))][:positives]
            for c, x in zip(out, (np.full(len(order), place), ids[order], s[order])):
                c.append(x)

    by_score = lambda s, i: (F.desc(s), i)
    first = W.partitionBy("place").orderBy(*by_score("positive_score", "positive_id"))
    pairs = fit.mapInArrow(best, "place long, positive_id long, positive_score long").distinct()
    chosen = pairs.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives).select("place", "positive_id", "positive_score").collect()  # ``positives`` rows an anchor of the block
    wanted: dict[int, list[tuple[int, int]]] = {}
    for r in chosen:
        wanted.setdefault(r.place, []).append((r.positive_id, r.positive_score))
    limits = spark.sparkContext.broadcast({p: np.array(sorted(x)).T for p, x in wanted.items()})

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["place", "positive_id", "positive_score", "negative_id", "negative_score"]
        out: list[list[np.ndarray]] = [[] for _ in names]
        for got in scored(batches):
            if got is None:
                if out[0]:
                    yield _batch(out, names)
                out = [[] for _ in names]
                continue
            place, _, kind, ids, labels, s = got
            if place not in limits.value:
                continue
            order = np.lexsort((ids, -s))
            order = order[labels[order] != kind]
            down = -s[order]
            for p, score in limits.value[place].T:
                most, least = int(upper) * int(score) // 100, -(-int(lower) * int(score) // 100)  # upper limit rounded down, lower one up
                begin = np.searchsorted(down, -most, "left")
                end = min(begin + k, np.searchsorted(down, -least, "right"))
                take = order[begin : max(begin, end)]
                for c, x in zip(out, (np.full(len(take), place), np.full(len(take), p), np.full(len(take), score), ids[take], s[take])):
                    c.append(x)

    near = fit.mapInArrow(between, "place long, positive_id long, positive_score long, negative_id long, negative_score long").distinct()
    nearest = W.partitionBy("place", "positive_id", "positive_score").orderBy(*by_score("negative_score", "negative_id"))
    ranked = near.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, h[0]) for i, h in enumerate(held)], "place long, anchor_id long")
    return ranked.join(F.broadcast(names), "place").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
