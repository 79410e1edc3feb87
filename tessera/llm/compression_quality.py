"""Quality classifier (3): how much better a text compresses with a dictionary of good text than with one of bad text.

Two zstandard dictionaries are built from pieces of labelled good and bad documents (a bounded sample). A whole text is cut into
pieces, each piece is compressed with both, and the normalised size differences go through a logistic calibration
fitted on labelled documents that did not enter the dictionaries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.calibrate import Logistic, labelled_sample
from tessera.llm.common import filter_rows, map_batches, remainder

#: Bytes of a piece of text; a long text counts by all its pieces.
PIECE = 1500
LEVEL = 3


def pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    n = max(1, round(len(raw) / PIECE))
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    calibration: Logistic | None = None

    def measure(self):
        """A function from text to the features of its sizes."""
        if not self.good or not self.bad:
            return lambda text: [0.0] * 5
        good, bad = (zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_AUTO), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad))
        plain = zstd.ZstdCompressor(level=LEVEL, write_content_size=False)

        def features(text: str | None) -> list[float]:
            parts = pieces(text)
            g = np.array([len(good.compress(p)) for p in parts], float)
            b = np.array([len(bad.compress(p)) for p in parts], float)
            n = np.array([len(p) for p in parts], float) + 20
            diff = (b - g) / np.maximum(b, g)
            whole = (text or "").encode()
            return [float((b.sum() - g.sum()) / max(b.sum(), g.sum())), float(diff.min()), float(diff.max()), float(g.sum() / n.sum()), len(plain.compress(whole)) / (len(whole) + 50)]

        return features

    def scorer(self):
        features = self.measure()
        return lambda texts: self.calibration(np.array([features(t) for t in texts]).reshape(len(texts), -1))


def _material(sample: DataFrame, y: int, bytes_limit: int) -> list[bytes]:
    """Pieces of one class, in the order of their hash, up to ``bytes_limit``; near copies are thinned by equal pieces."""

    def make():
        def step(texts):
            return {"piece": [p for t in texts for p in pieces(t)]}

        return step

    found = map_batches(sample.where(f"half = 0 and y = {y}"), ["text"], "piece binary", make).dropDuplicates(["piece"])
    return [bytes(r.piece) for r in found.orderBy(F.xxhash64("piece"), "piece").limit(bytes_limit // PIECE).collect()]


def fit_quality(docs: DataFrame, labels: DataFrame, *, per_class: int = 3000, material_bytes: int = 6 << 20, dictionary_bytes: int = 112 << 10) -> QualityModel:
    """Dictionaries and calibration from at most ``2 * per_class`` labelled documents."""
    sample = labelled_sample(docs, labels, "quality", per_class=per_class)
    good, bad = (_dictionary(_material(sample, y, material_bytes), dictionary_bytes) for y in (1, 0))
    model = QualityModel(good, bad)

    def make():
        features = model.measure()

        def step(texts, ys):
            return {"x": [features(t) for t in texts], "y": ys}

        return step

    rows = map_batches(sample.where("half = 1"), ["text", "y"], "x array<double>, y int", make).collect()  # five numbers for each document of the bounded sample
    # the sample holds the classes in other shares than the corpus: weigh them back by the labels' own counts
    share = {r.y: r.n for r in labels.where((remainder(5) != 0) & F.col("quality").isin(0, 1)).groupBy(F.col("quality").alias("y")).agg(F.count("*").alias("n")).collect()}
    x, y = np.array([r.x for r in rows]).reshape(len(rows), 5), np.array([r.y for r in rows])
    model.calibration = Logistic(x, y)
    if model.calibration.w is not None:
        ratio = (share.get(1, 0) / max(1, share.get(0, 0))) / (max(1, (y == 1).sum()) / max(1, (y == 0).sum()))
        model.calibration.w[0] += np.log(max(ratio, 1e-6))
    return model


def _dictionary(material: list[bytes], size: int) -> bytes:
    """A trained dictionary; with too little material for training, the material itself."""
    if sum(map(len, material)) < 8 * size or len(material) < 50:
        return b"".join(material)[-size:]
    try:
        return zstd.train_dictionary(size, material).as_bytes()
    except zstd.ZstdError:
        return b"".join(material)[-size:]


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    A null text counts as empty; an empty text is scored like any other, by the sizes of nothing. A null doc_id is in no fold. Without
    labels of both classes every score is the smoothed base rate. Repeated rows are scored each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, **options))

    def make():
        score = shared.value.scorer()
        return lambda keys, texts: {"doc_id": keys, "score": score(texts)}

    scored = map_batches(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", make)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs``, all their columns, that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, **options))

    def make():
        score = shared.value.scorer()
        return lambda texts: score(texts) >= threshold

    return filter_rows(docs, ["text"], make)
