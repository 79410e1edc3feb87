"""Benchmark decontamination (2): latent semantic retrieval of benchmark passages, then subsequence and answer checks.

Passages are windows of ``WINDOW`` words. TF-IDF weights (document frequencies counted over the whole corpus) over hashed words make their
vectors; an SVD of every ``SPACE`` passages gives their latent space, so what it keeps of a passage does not fall as the benchmark grows.
Every window of every document is projected and compared with all benchmark passages (a stated query set, in blocks); pairs over a
cosine are candidates, and so is every place where one of a passage's rarest runs of three words stands. A candidate counts if the longest common subsequence of words covers enough of the passage, and if
its answer, the last words, is covered too where the wording differs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filter_rows, map_batches, stored
from tessera.llm.words import word_hashes

FEATURES = 1 << 15
HOP, WINDOW = 16, 48
#: Benchmark items, and bytes of their texts, in one block of the query set.
BLOCK, BLOCK_BYTES = 8192, 8 << 20
#: Blocks that a worker holds at once.
AT_ONCE = 2
#: Passages in one latent space, and runs of three words by which a passage is also looked up.
SPACE, RUNS = 256, 4

#: Bytes of texts that are hashed and searched together; longer texts go in cuts that overlap.
GROUP_BYTES = 1 << 19
#: Features in more than this share of the documents, and in this number of them at least, carry no weight.
COMMON, COMMON_DOCS = 1 / 16, 100

_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def spaced(text: str | None) -> bytes:
    """Lower-case UTF-8 with spaces for ASCII punctuation."""
    return (text or "").encode().translate(_SPACED).lower()


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return spaced(text).split()


@dataclass
class Group:
    """Words of several texts side by side: ``cuts`` are (text, its first word here, the word after its last); a long text has several."""

    raw: bytes
    features: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    cuts: list[tuple[int, int, int]]

    def words(self, a: int, b: int) -> list[bytes]:
        return self.raw[self.starts[a] : self.ends[b - 1]].split() if b > a else []


def hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features, starts and ends of the words in ``raw``, all at once: a word's feature is a part of its hash."""
    h, starts, ends = word_hashes(raw)
    return (h >> np.uint64(49)).astype(np.int32), starts, ends


def _cuts(raw: bytes) -> Iterator[bytes]:
    """``raw`` itself, or pieces of it at spaces, each beginning two windows of words before the last one's end."""
    at = 0
    while True:
        end = raw.find(b" ", at + GROUP_BYTES)
        if end < 0:
            yield raw[at:]
            return
        yield raw[at:end]
        back = end
        for _ in range(2 * WINDOW):  # a word at a time
            while back > at and raw[back - 1] == 32:
                back -= 1
            back = max(at, raw.rfind(b" ", at, back))
        at = back if back > at else end


def grouped(texts: list[str | None]) -> Iterator[Group]:
    """The texts in groups of about ``GROUP_BYTES``."""
    held, size = [], 0

    def group() -> Group:
        raw = b" ".join(x for _, x in held)
        features, starts, ends = hashed(raw)
        bounds = np.cumsum([0, *(len(x) + 1 for _, x in held)])
        first = np.searchsorted(starts, bounds).tolist()
        return Group(raw, features, starts, ends, [(i, a, z) for (i, _), a, z in zip(held, first, first[1:])])

    for i, text in enumerate(texts):
        for raw in _cuts(spaced(text)):
            held.append((i, raw))
            size += len(raw)
            if size >= GROUP_BYTES:
                yield group()
                held, size = [], 0
    if held:
        yield group()


def passages(words: list[bytes]) -> list[list[bytes]]:
    """An item's passages: equal cuts of at most ``WINDOW`` words."""
    n = max(1, -(-len(words) // WINDOW))
    cuts = [len(words) * i // n for i in range(n + 1)]
    return [words[a:b] for a, b in zip(cuts, cuts[1:])]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, over all rows; at most ``FEATURES`` sums come to the driver."""

    def make():
        place = np.zeros(FEATURES, np.int32)

        def step(texts):
            df, last = np.zeros(FEATURES, np.int64), (-1, np.zeros(FEATURES, bool))
            for g in grouped(texts):
                for i, a, z in g.cuts:
                    f, here = g.features[a:z], np.arange(z - a, dtype=np.int32)
                    place[f] = here
                    f = f[place[f] == here]  # each feature once
                    if z == len(g.features) or last[0] == i:  # the text may go on in the next group
                        last = last if last[0] == i else (i, np.zeros(FEATURES, bool))
                        f = f[~last[1][f]]
                        last[1][f] = True
                    df[f] += 1
            at = np.flatnonzero(df)
            return {"f": [-1, *at.tolist()], "n": [len(texts), *df[at].tolist()]}

        return step

    df, n = np.zeros(FEATURES), 0
    for r in map_batches(docs, ["text"], "f int, n long", make).groupBy("f").agg(F.sum("n").alias("n")).collect():
        if r.f < 0:
            n = r.n
        else:
            df[r.f] = r.n
    return df, n


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies, 0 for features of too many documents."""
    return np.where(df > max(COMMON * n, COMMON_DOCS), 0.0, np.log((n + 2) / (df + 1)))


def _runs(features: np.ndarray) -> np.ndarray:
    """One number for every three features in a row."""
    f = features.astype(np.int64)
    return (f[:-2] << 30) + (f[1:-1] << 15) + f[2:] if len(f) > 2 else np.zeros(0, np.int64)


def _slot(runs: np.ndarray) -> np.ndarray:
    return (runs * 0x9E3779B97F4A7 >> 20) & ((1 << 20) - 1)


def _rows(parts: list[list[bytes]], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit TF-IDF rows, sparse; a row of common words alone is empty."""
    out = []
    for p in parts:
        f, c = np.unique(hashed(b" ".join(p))[0], return_counts=True)
        f, c = f[idf[f] > 0], c[idf[f] > 0]
        x = c * idf[f]
        out.append((f, x / (np.linalg.norm(x) or 1.0)))
    return out


def latent_space(rows: list[tuple[np.ndarray, np.ndarray]], *, rank: int = 160, kept: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """Features that occur, and their rows in the space of the leading right singular vectors of the matrix A of these unit rows.

    ``rank`` axes, or as many more as it takes to keep that share of the energy of every row, so no passage is lost to the others.
    """
    used = np.unique(np.concatenate([f for f, _ in rows]))
    if not len(used):
        return used, np.zeros((0, 1))
    a = np.zeros((len(rows), len(used)))
    for i, (f, x) in enumerate(rows):
        a[i, np.searchsorted(used, f)] = x
    values, left = np.linalg.eigh(a @ a.T)
    order = np.argsort(-values)[: max(1, int((values > 1e-9).sum()))]
    values, left = np.maximum(values[order], 1e-12), left[:, order]
    shares = np.cumsum(left**2 * values, 1) / np.maximum((a**2).sum(1), 1e-12)[:, None]
    width = max(rank, 1 + int(np.argmax((shares >= kept - 1e-6) | (np.arange(len(order)) == len(order) - 1), axis=1).max()))
    return used, a.T @ (left[:, :width] / np.sqrt(values[:width]))


def common_subsequence(masks: dict[bytes, int], length: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, a whole row of the table at once in the bits of an integer."""
    full = (1 << length) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


@dataclass
class Passage:
    item: int
    words: list[bytes]

    def __post_init__(self):
        self.masks, self.tail = self._masks(self.words), self.words[-max(4, len(self.words) // 4) :]
        self.tail_masks = self._masks(self.tail)
        self.times = Counter(self.words)

    @staticmethod
    def _masks(words: list[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def at_most(self, region: set[bytes]) -> float:
        """No order of the region's words covers more of the passage."""
        return sum(map(self.times.__getitem__, self.times.keys() & region)) / len(self.words)

    def match(self, region: list[bytes], *, sure: float, wording: float, answer: float) -> float:
        """Share of the passage that the region holds in order, or 0 if it does not count."""
        n = len(self.words)
        share = common_subsequence(self.masks, n, region) / n
        if n < 8:
            return share if share == 1.0 and b" %s " % b" ".join(self.words) in b" %s " % b" ".join(region) and n >= 3 else 0.0
        if share >= sure:
            return share
        if share >= wording and common_subsequence(self.tail_masks, len(self.tail), region) >= answer * len(self.tail):
            return share
        return 0.0


class Space:
    """The latent space of at most ``SPACE`` passages, and their places in it."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, rank: int):
        used, axes = latent_space(rows, rank=rank)
        # row 0 stands for all features that do not occur
        self.row = np.zeros(FEATURES, np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.table = np.vstack([np.zeros((1, axes.shape[1])), axes * idf[used, None]]).astype(np.float32)
        # passages stand with unit length in the latent space
        self.index = np.array([x @ axes[np.searchsorted(used, f)] for f, x in rows], np.float32)
        self.index /= np.linalg.norm(self.index, axis=1, keepdims=True) + 1e-9

    def windows(self, features: np.ndarray, hop: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Latent vectors of the windows that begin at every hop, by the length that the windows have with all their words.

        ``hop`` is that of each word, ascending. So a window that has little in common with the benchmark is near to nothing, whatever its direction.
        """
        rows = self.row[features]
        sums = np.zeros((len(lengths) + 2, self.table.shape[1]), np.float32)
        at = np.flatnonzero(rows)
        if len(at):
            held, begin, n = np.unique(hop[at], return_index=True, return_counts=True)
            for k in range(n.max()):  # the k-th word of every hop that has so many
                more = n > k
                sums[held[more]] += self.table[rows[at[begin[more] + k]]]
        return (sums[:-2] + sums[1:-1] + sums[2:]) / lengths[:, None]


class Search:
    """Finds benchmark passages in documents; built on each executor."""

    def __init__(self, passages: list[Passage], spaces: list[Space], idf: np.ndarray, *, cosine: float, sure: float, wording: float, answer: float):
        self.cosine = cosine
        self.checks = {"sure": sure, "wording": wording, "answer": answer}
        self.passages, self.spaces, self.energy = passages, spaces, (idf**2).astype(np.float32)
        # the rarest runs of three words of each passage, with their places in it: whoever holds a whole passage holds them all
        self.runs: dict[int, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.passages):
            f = hashed(b" ".join(p.words))[0]
            runs, rare = _runs(f), idf[f[:-2]] + idf[f[1:-1]] + idf[f[2:]] if len(f) > 2 else np.zeros(0)
            for o in np.argsort(-rare, kind="stable")[:RUNS].tolist():
                self.runs.setdefault(int(runs[o]), []).append((k, o))
        self.whole = {b" ".join(p.words): p.item for p in passages if len(p.words) < 3}
        self.seen = np.zeros(1 << 20, bool)
        self.seen[_slot(np.fromiter(self.runs, np.int64, len(self.runs)))] = True

    def candidates(self, g: Group) -> list[tuple[int, int, int]]:
        """(cut, hop in it, passage), ascending: windows near a passage in its latent space, and those where one of its rarest runs stands."""
        first, n = np.array([a for _, a, _ in g.cuts]), np.array([z - a for _, a, z in g.cuts])
        # every cut begins a hop, and two empty hops behind it keep its windows from its neighbour's
        hops = -(-n // HOP) + 2
        base = np.cumsum(hops) - hops
        cut = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(cut)) - np.repeat(first, n)
        hop = base[cut] + place // HOP
        energy = np.bincount(hop, self.energy[g.features], int(hops.sum()) + 2)
        lengths = np.sqrt(energy[:-2] + energy[1:-1] + energy[2:] + 1e-9).astype(np.float32)
        found, before = set(), 0
        for s in self.spaces:
            near = s.windows(g.features, hop, lengths)
            # no passage is nearer than a vector is long
            long = np.flatnonzero(np.einsum("ij,ij->i", near, near) >= self.cosine**2)
            at, passage = np.nonzero(near[long] @ s.index.T >= self.cosine)
            at = long[at]
            of = np.searchsorted(base, at, side="right") - 1
            found.update(zip(of.tolist(), (at - base[of]).tolist(), (passage + before).tolist()))
            before += len(s.index)
        runs = _runs(g.features)
        for i in np.flatnonzero(self.seen[_slot(runs)]).tolist():
            for k, o in self.runs.get(int(runs[i]), ()) if cut[i] == cut[i + 2] else ():
                found.add((int(cut[i]), max(0, int(place[i]) - o) // HOP, k))
        return sorted(found)

    def of(self, texts: list[str | None]) -> list[dict[int, float]]:
        """For each text: item -> the best share found."""
        found: list[dict[int, float]] = [{} for _ in texts]
        if not self.passages:
            return found
        for g in grouped(texts):
            if not len(g.features):
                continue
            last, region, held = None, [], set()
            for i, a, z in g.cuts if self.whole else ():
                if z - a < 3 and (item := self.whole.get(b" ".join(g.words(a, z)))) is not None:
                    found[i][item] = 1.0
            for c, h, p in self.candidates(g):
                q, (i, a, z) = self.passages[p], g.cuts[c]
                got = found[i]
                if (c, h) != last:
                    last, region = (c, h), g.words(max(a, a + HOP * h - HOP), min(z, a + HOP * h + WINDOW + HOP))
                    held = set(region)
                if got.get(q.item, 0.0) < 1.0 and q.at_most(held) >= min(self.checks["wording"], self.checks["sure"]):
                    share = q.match(region, **self.checks)
                    if share > got.get(q.item, 0.0):
                        got[q.item] = share
        return found


def _searches(docs: DataFrame, items: DataFrame, *, rank: int = 160, cosine: float = 0.22, sure: float = 0.75, wording: float = 0.6, answer: float = 0.6) -> Iterator[Callable[[], list[Search]]]:
    """Makers of the searches for ``AT_ONCE`` blocks of the benchmark each, so that no worker holds more of it; the next ones replace them."""
    clean = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    idf = weights(*document_frequencies(docs))
    size = clean.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size.n // BLOCK), -(-size.b // BLOCK_BYTES))
    context = docs.sparkSession.sparkContext

    def block(b: int) -> Broadcast:
        rows = clean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        held = [Passage(r.item_id, p) for r in rows for p in passages(tokens(r.text)) if p]
        vectors = _rows([p.words for p in held], idf)
        n = -(-len(held) // SPACE)
        cuts = [len(held) * i // n for i in range(n + 1)] if n else []
        return context.broadcast((held, [Space(vectors[a:z], idf, rank) for a, z in zip(cuts, cuts[1:])], idf))

    for first in range(0, blocks, AT_ONCE):
        shared = [block(b) for b in range(first, min(blocks, first + AT_ONCE))]
        yield lambda shared=shared: [Search(*s.value, cosine=cosine, sure=sure, wording=wording, answer=answer) for s in shared]


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending) and best_share for every row of ``docs``.

    Null and empty texts hold nothing; null or empty items are not searched. Items of 3 to 7 words must stand word for word, shorter ones must
    be a whole text. Repeated rows are judged each. With an empty benchmark nothing is contaminated. A benchmark of more than
    ``AT_ONCE`` blocks takes several passes over the texts.
    """
    kind, found = docs.schema["doc_id"].dataType.simpleString(), "item_ids array<long>, best_share double"
    rows = docs.select("doc_id", "text", F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("best_share"))
    for n, maker in enumerate(_searches(docs, items, **options)):

        def make(maker=maker):
            searches = maker()

            def step(keys, texts, known, best):
                got = [dict.fromkeys(k, 0.0) for k in known]
                for s in searches:
                    for g, x in zip(got, s.of(texts)):
                        g.update(x)
                return {"doc_id": keys, "text": texts, "item_ids": [sorted(g) for g in got], "best_share": [max([b, *g.values()]) for b, g in zip(best, got)]}

            return step

        rows = stored(rows, "searched") if n else rows
        rows = map_batches(rows, ["doc_id", "text", "item_ids", "best_share"], f"doc_id {kind}, text string, {found}", make)
    return rows.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "best_share")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no benchmark passage.

    Null and empty texts stay; rows without doc_id and repeated rows are judged each; an empty table stays empty.
    """
    rows = docs
    for n, maker in enumerate(_searches(docs, items, **options)):

        def make(maker=maker):
            searches = maker()

            def keep(texts):
                hit = [False] * len(texts)
                for s in searches:
                    hit = [h or bool(x) for h, x in zip(hit, s.of(texts))]
                return [not h for h in hit]

            return keep

        rows = filter_rows(stored(rows, "searched") if n else rows, ["text"], make)
    return rows
