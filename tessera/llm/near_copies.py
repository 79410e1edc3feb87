"""SimHash near-dedup (8) at a similarity: texts whose sets of five-word windows have an exact Jaccard similarity of 0.8 or more are linked.

64 bits tell little at 0.8, so the fingerprints here are wider: each bit is the majority of a bit of the windows' hashes, and the bits go, those that
go together first, into ``parts`` partitions. By the generalised pigeonhole principle two fingerprints that differ in at most ``parts - 1`` bits agree in
some partition within its threshold, whatever thresholds with sum 0 each of them takes; dynamic programming over estimated candidates gives every
fingerprint its own: 0 mostly, -1 (not looked at) where its value is common, 1 (all values one bit away too) where that is cheaper. Pairs
at 0.8 differ in more bits; width and number of partitions are such that they still share one but for a chance of ``MISS``.

Texts of equal sets are one row from the start. Who meets in a partition is tested on sizes and 128 bits of the fingerprints, then on
all bits of a wider fingerprint, of ``WIDE`` words, in the second round of ``FINE`` words, and every link is verified on the whole sets. A first round gives each text its ``NEAREST`` partners at most and
looks at only ``LEADERS`` rows of crowded values; the second tests all that share a value and are not in one component yet, on all bits where they meet, and names a pair
only in the first partition in which it meets: a large group of copies costs no pair twice and no link of a candidate is lost. A value of more than ``CROWD`` rows is dealt over several tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filter_rows, map_batches, stored
from tessera.llm.components import components
from tessera.llm.simhash import allocate, ball_counts, correlated_groups, dealt

MISS = 1e-3
#: Rows of a value after which only its first ``LEADERS`` are met in the first round, and rows that one task takes of it.
CROWDED, LEADERS, CROWD = 2048, 64, 20_000
#: Nearest partners of a text that the first round verifies, and that a batch of rows names.
NEAREST, NAMED = 8, 1
#: 64-bit words of the fingerprints by which pairs are tested; the first of them make up the partitions. ``FINE`` ones are made in the second round, for the
#: texts that are left: in a large group of texts that are a little less alike than asked for, they tell most pairs apart where they meet.
WIDE, FINE = 16, 64
#: Nodes that are sent to all executors at most; more are joined.
BROADCAST = 1 << 21
#: Bits of a partition's value by which candidates are counted, and fingerprints from which correlations are estimated.
COUNTED, SAMPLE = 12, 8192
_LANES = np.uint64(0x0101010101010101)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """word -> hash, remembered by the worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 42)
        return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def windows(text: str | None, hashed: dict, shingle: int = 5) -> np.ndarray:
    """Ascending hashes of the distinct windows of ``shingle`` words; a shorter text is one window, also one without words."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(h))
    total = np.full(max(1, len(h) - shingle + 1), width, np.uint64)
    for k in range(width):
        total = _mix(total + h[k : k + len(total)])
    return np.unique(total)


def differing(similarity: float) -> float:
    """The share of bits in which sets of that Jaccard similarity and equal size differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shape_of(n: int, similarity: float) -> tuple[int, int]:
    """(64-bit words of a fingerprint, partitions) for ``n`` texts: a value holds about 128 unlike texts, and one in 1 / ``MISS`` pairs is missed."""
    width = max(10.0, math.log2(max(n, 1)) - 7)
    parts = math.ceil(math.log(MISS) / math.log1p(-((1 - differing(similarity)) ** width)))
    return -(-math.ceil(parts * width) // 64), parts


def signatures(sets: list[np.ndarray], words: int) -> list[bytes]:
    """Fingerprints of 64 * ``words`` bits: the majority of each bit of the members' hashes."""
    out: list[bytes] = []
    sizes = np.array([len(s) for s in sets], np.int64)
    # some thousand members at a time stay in the processor's cache; a set is never cut
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // 4096, prepend=-1)).tolist() + [len(sets)]
    for a, z in zip(cuts, cuts[1:]):
        n, held = sizes[a:z], np.concatenate(sets[a:z])
        # counts are summed in the bytes of an integer, so over at most 255 members
        first = np.cumsum(n) - n
        chunks = -(-n // 255)
        chunk_first = np.cumsum(chunks) - chunks
        at = np.repeat(first - 255 * chunk_first, chunks) + 255 * np.arange(int(chunks.sum()))
        bits = np.empty((len(n), words, 8, 8), bool)
        for w in range(words):
            x = _mix(held * (_ODD + np.uint64(2 * w)))
            for j in range(8):
                lanes = np.add.reduceat((x >> np.uint64(j)) & _LANES, at).view(np.uint8).reshape(-1, 8)
                bits[:, w, j] = 2 * np.add.reduceat(lanes.astype(np.int64), chunk_first) > n[:, None]
        packed = np.packbits(bits.reshape(len(n), -1), axis=1)
        out += [row.tobytes() for row in packed]
    return out


def _node(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes(), 42) - (1 << 63)


def _bits(signs: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), -1), axis=1)


def _values(signs: list[bytes], groups: list[list[int]]) -> np.ndarray:
    """Each fingerprint's value in each partition: rows x partitions."""
    if not signs:
        return np.zeros((0, len(groups)), np.int64)
    bits = _bits(signs)
    return np.stack([bits[:, g].astype(np.int64) @ (1 << np.arange(len(g), dtype=np.int64)) for g in groups], 1)


def thresholds(classes: DataFrame, groups: list[list[int]]) -> DataFrame:
    """``classes`` with ``asks``: the threshold of each partition plus 1, a byte each."""
    parts, least = len(groups), 1 << COUNTED

    def count():
        def step(signs):
            slot, n = np.unique((_values(signs, groups) & (least - 1)) + np.arange(parts) * least, return_counts=True)
            return {"slot": slot, "n": n}

        return step

    counts = np.zeros(parts * least)
    for slot, n in map_batches(classes, ["sign"], "slot int, n long", count).groupBy("slot").agg(F.sum("n")).toPandas().to_numpy().tolist():  # at most parts x 4096 rows
        counts[int(slot)] = n
    shared = classes.sparkSession.sparkContext.broadcast(counts.reshape(parts, least).astype(np.float32))

    def make():
        price = []
        for g, c in zip(groups, shared.value):
            near = ball_counts(c, 1, COUNTED) / 2.0 ** max(0, len(g) - COUNTED)
            price.append(np.vstack([np.zeros(least), near[0] + 1, near[1] + 1 + len(g)]).astype(np.float32))

        def step(nodes, least_rows, ns, signs):
            v, out = _values(signs, groups) & (least - 1), []
            for at in range(0, len(nodes), 2048):
                costs = np.stack([p[:, v[at : at + 2048, i]].T for i, p in enumerate(price)], 1)
                out += [r.tobytes() for r in (allocate(costs, parts - 1) + 1).astype(np.uint8)]
            return {"node": nodes, "least": least_rows, "n": ns, "sign": signs, "asks": out}

        return step

    schema = classes.select("node", "least", "n", "sign").schema.add("asks", "binary")
    return map_batches(classes, ["node", "least", "n", "sign"], schema, make)


def _rows(classes: DataFrame, groups: list[list[int]], *, whole: bool) -> DataFrame:
    """A row for every value at which a class stands (kind 1: and looks, 0: without looking) or only looks (kind 2); ``whole``: with its wide fingerprint and thresholds."""

    def make():
        def step(nodes, roots, ns, signs, asks, wide=()):
            v = _values(signs, groups)
            node, root, n = (np.array(x, np.int64) for x in (nodes, roots, ns))
            t = np.frombuffer(b"".join(asks), np.uint8).reshape(len(nodes), len(groups))
            check = np.frombuffer(b"".join(s[:16] for s in signs), "<i8").reshape(-1, 2)
            slot, at, kind = [], [], []
            for i, g in enumerate(groups):
                slot.append(v[:, i] + (i << 32))
                at.append(np.arange(len(node)))
                kind.append((t[:, i] > 0).astype(np.int8))
                far = np.flatnonzero(t[:, i] > 1)
                slot.append((v[far, i][:, None] ^ (1 << np.arange(len(g)))).ravel() + (i << 32))
                at.append(np.repeat(far, len(g)))
                kind.append(np.full(len(far) * len(g), 2, np.int8))
            at = np.concatenate(at)
            out = {"slot": np.concatenate(slot), "kind": np.concatenate(kind), "root": root[at], "node": node[at], "n": n[at], "c0": check[at, 0], "c1": check[at, 1]}
            return out | {"asks": [asks[i] for i in at], "wide": [wide[i] for i in at]} if whole else out

        return step

    return map_batches(classes, ["node", "root", "n", "sign", "asks", *["wide"] * whole], "slot long, kind byte, root long, node long, n int, c0 long, c1 long" + ", asks binary, wide binary" * whole, make)


_ORDER = ["slot", "cell", "root", "node", "kind", "block", "n", "c0", "c1"]


def _most(bits: int, similarity: float) -> float:
    """In how many of so many bits a pair of that similarity may differ: 3.5 standard deviations over what it gives."""
    p = differing(similarity)
    return bits * p + 3.5 * math.sqrt(bits * p * (1 - p))


def _alike(x: np.ndarray, y: np.ndarray, asks: np.ndarray, wide: np.ndarray, part: np.ndarray, groups: list[list[int]], similarity: float) -> np.ndarray:
    """Which of the pairs of rows ``x`` and ``y``, met in partition ``part``, are near on all bits and meet in no partition before."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 16):
        a, b = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
        near = np.flatnonzero(np.bitwise_count(wide[a] ^ wide[b]).sum(1, dtype=np.int64) <= _most(64 * wide.shape[1], similarity))
        a, b, here = a[near], b[near], part[a[near]]
        rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        values, looks = _values([r.tobytes() for r in wide[rows]], groups), asks[rows]
        i, j = place[: len(a)], place[len(a) :]
        apart, most = np.bitwise_count((values[i] ^ values[j]).view(np.uint64)), np.maximum(looks[i], looks[j])
        met = ((apart == 0) & (most > 0)) | ((apart == 1) & (most > 1))
        out[at + near] = np.argmax(met, 1) == here if len(near) else False
    return out


def _meetings(similarity: float, leaders: bool, groups: list[list[int]]):
    """Over rows in that order: pairs of one value that may be similar and are of different roots, ``a`` under ``b``, and the bits in which they differ.

    With ``leaders`` each row gives its nearest partners only, rows far down a crowded value meet its first rows only, and all rows that
    have a partner or stand in a crowded value are named (a is b).
    """
    most = _most(128, similarity)

    def run(batches):
        held = None
        for batch in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not leaders and len(got[0]):
                got[9:] = [np.frombuffer(b"".join(got[9]), np.uint8).reshape(len(got[0]), -1), np.frombuffer(b"".join(got[10]), np.uint64).reshape(len(got[0]), -1)]
            old = 0
            if held is not None and len(got[0]) and held[0][0] == got[0][0] and held[1][0] == got[1][0]:
                old, got = len(held[0]), [np.concatenate(x) for x in zip(held, got)]
            if not len(got[0]):
                continue
            slot, cell, root, node, kind, block, n, c0, c1, *whole = got
            here = np.arange(len(slot))
            fresh = np.concatenate([[True], (slot[1:] != slot[:-1]) | (cell[1:] != cell[:-1])])
            start = np.maximum.accumulate(np.where(fresh, here, 0))
            other = np.maximum.accumulate(np.where(fresh | np.concatenate([[True], root[1:] != root[:-1]]), here, 0))
            back = other - start
            if leaders:
                back = np.where(here - start >= CROWDED, np.minimum(back, LEADERS), back)
            back[:old] = 0
            ends = np.cumsum(back)
            pairs = []
            for at in range(0, int(ends[-1]), 1 << 20):
                k = np.arange(at, min(at + (1 << 20), int(ends[-1])))
                x = np.searchsorted(ends, k, side="right")
                y = start[x] + k - (ends[x] - back[x])
                apart = np.bitwise_count((c0[x] ^ c0[y]).view(np.uint64)) + np.bitwise_count((c1[x] ^ c1[y]).view(np.uint64))
                near = apart <= most
                x, y, apart = x[near], y[near], apart[near].astype(np.int64)
                ok = (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])) & ((kind[x] > 0) | (kind[y] > 0)) & ((kind[x] < 2) | (kind[y] < 2)) & (node[x] != node[y])
                ok &= (cell[x] % (1 << 20) == cell[x] >> 20) | (block[x] != block[y])
                if not leaders:
                    x, y, apart, ok = x[ok], y[ok], apart[ok], np.ones(int(ok.sum()), bool)
                    ok = _alike(x, y, *whole, slot >> 32, groups, similarity)
                pairs.append(np.stack([np.minimum(node[x], node[y])[ok], np.maximum(node[x], node[y])[ok], apart[ok]]))
            a, b, d = np.unique(np.concatenate(pairs, 1), axis=1) if pairs else np.zeros((3, 0), np.int64)
            if leaders:
                crowded = node[np.flatnonzero(np.bincount(start, minlength=len(slot))[start] > CROWDED)]
                order = np.lexsort((d, b))
                first = np.flatnonzero(np.concatenate([[True], b[order][1:] != b[order][:-1]])) if len(b) else order
                keep = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < NAMED]
                named = np.setdiff1d(np.concatenate([a, crowded]), b[keep])  # the others are named as they are
                a, b, d = np.concatenate([a[keep], named]), np.concatenate([b[keep], named]), np.concatenate([d[keep], 0 * named])
            held = [c[start[-1] :] for c in got]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "d"])

    return run


def _met(classes: DataFrame, groups: list[list[int]], similarity: float, *, leaders: bool) -> DataFrame:
    """What ``_meetings`` says of ``classes`` (node, root, n, sign, asks)."""
    rows = dealt(_rows(classes, groups, whole=not leaders), CROWD, pairs=not leaders)
    ordered = rows.select(*_ORDER, *[] if leaders else ["asks", "wide"]).repartition("slot", "cell").sortWithinPartitions(*_ORDER[:4])
    return ordered.mapInArrow(_meetings(similarity, leaders, groups), "a long, b long, d long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets are that similar: first by all bits, with slack, then by the whole sets."""

    def ends(found: DataFrame, held: DataFrame) -> DataFrame:
        return found.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")

    def near():
        def keep(x, y):
            return [(int.from_bytes(a) ^ int.from_bytes(b)).bit_count() <= _most(8 * len(a), similarity) for a, b in zip(x, y)]

        return keep

    def sets():
        hashed = Words()

        def step(texts):
            held = [windows(t, hashed, shingle) for t in texts]
            return {"node": [_node(h) for h in held], "held": [h.tobytes() for h in held]}

        return step

    def exact():
        def keep(x, y):
            out = []
            for s, t in zip(x, y):
                a, b = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(both >= similarity * (len(a) + len(b) - both))
            return out

        return keep

    left = stored(filter_rows(ends(pairs, classes.select("node", "wide")), ["x", "y"], near).select("a", "b"), "candidates")
    if left.isEmpty():
        return left
    wanted = stored(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    small = wanted.count() <= BROADCAST
    held = map_batches(docs, ["text"], "node long, held binary", sets).join(F.broadcast(wanted) if small else wanted, "node", "left_semi").dropDuplicates(["node"])
    return stored(filter_rows(ends(left, stored(held, "sets")), ["x", "y"], exact).select("a", "b"), "similar")


def _groups(classes: DataFrame, parts: int) -> list[list[int]]:
    """The fingerprints' bits in ``parts`` groups, by their correlations over about ``SAMPLE`` classes drawn by a hash."""
    draw = F.pmod(F.xxhash64(F.lit("groups"), "node"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(1, classes.count())) * (1 << 30)))
    signs = [bytes(r.sign) for r in classes.where(draw).select("sign").collect()]
    bits = _bits(signs).astype(np.float64) if len(signs) > 1 else np.zeros((2, 8 * len(signs[0]) if signs else 64))
    bits -= bits.mean(0)
    scale = np.sqrt((bits**2).sum(0)) + 1e-9
    return correlated_groups(np.abs(bits.T @ bits) / np.outer(scale, scale), parts)


def _linked(docs: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, node) of every row, ``key`` a hash of its text, and (node, root, least) of every class, ``least`` the least (doc_id, key) in it."""
    words, parts = shape_of(docs.count(), similarity)
    wide = max(words, WIDE)

    def make():
        hashed = Words()

        def step(keys, texts, hashes):
            held = [windows(t, hashed, shingle) for t in texts]
            return {"doc_id": keys, "key": hashes, "node": [_node(h) for h in held], "n": [len(h) for h in held], "wide": signatures(held, wide) if held else []}

        return step

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    rows = stored(map_batches(keyed, ["doc_id", "text", "key"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, node long, n int, wide binary", make), "windows")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))
    classes = stored(rows.groupBy("node").agg(F.min(named).alias("least"), F.first("n").alias("n"), F.first("wide").alias("wide")).withColumn("sign", F.expr(f"substring(wide, 1, {8 * words})")), "classes")
    groups = _groups(classes, parts)
    asked = stored(thresholds(classes, groups), "asked")
    # a text's partners here are at most NAMED for each of its values and batches of rows; any order among equally near ones will do, so not the same for all
    near = F.collect_set(F.when(F.col("a") != F.col("b"), F.struct("d", F.xxhash64("a", "b").alias("h"), "a")))
    met = _met(asked.withColumn("root", F.col("node")), groups, similarity, leaders=True)
    first = stored(met.groupBy("b").agg(F.slice(F.array_sort(near), 1, NEAREST)["a"].alias("partners")), "first")
    tried = first.select(F.explode("partners").alias("a"), "b")
    links = _verified(tried, classes, docs, similarity, shingle)
    rooted = lambda some, found: some.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = stored(rooted(asked.join(first.select(F.col("b").alias("node")), "node", "left_semi"), links), "open")
    left = left.join(_finer(docs, rows, left, max(words, FINE), shingle), "node")
    rest = _met(left, groups, similarity, leaders=False).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(_verified(rest, classes, docs, similarity, shingle))
    return rows.select("doc_id", "key", "node"), stored(rooted(classes.select("node", "least"), links), "rooted")


def _finer(docs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, shingle: int) -> DataFrame:
    """node and its fingerprint of so many words: texts of ``nodes`` are found by their hashes, and only these are cut into windows again."""
    wanted = stored(rows.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key").distinct(), "finer")
    small = wanted.count() <= BROADCAST

    def make():
        hashed = Words()

        def step(texts):
            held = [windows(t, hashed, shingle) for t in texts]
            return {"node": [_node(h) for h in held], "wide": signatures(held, words) if held else []}

        return step

    some = docs.select("text", F.xxhash64("text").alias("key")).join(F.broadcast(wanted) if small else wanted, "key", "left_semi")
    return stored(map_batches(some, ["text"], "node long, wide binary", make).dropDuplicates(["node"]), "fine")


def near_copies(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id and component_id (the least doc_id that links reach) for every row.

    Null and empty texts are copies of each other. A row without doc_id takes part; a component of such rows alone has a null id.
    Repeated rows stay, an empty table stays empty, other columns are not looked at.
    """
    rows, rooted = _linked(docs, similarity, shingle)
    least = rooted.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of ``docs``, with all columns, of each component: that with the least doc_id, and of several texts under that id that with the least hash.

    Rows without doc_id stay. Equal rows of one id count once; another text under the same id is judged by itself. An empty table stays empty.
    """
    _, rooted = _linked(docs, similarity, shingle)
    mark = "_hash"
    while mark in docs.columns:  # no column of ``docs`` is written over
        mark += "_"
    best = rooted.groupBy("root").agg(F.min("least").alias("x")).where("x is not null").select(F.col("x.doc_id").alias("doc_id"), F.col("x.key").alias(mark))
    kept = docs.withColumn(mark, F.xxhash64("text")).join(best, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
