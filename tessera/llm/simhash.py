"""SimHash near-dedup (8): 64-bit fingerprints, linked within a few bits by the generalised pigeonhole principle.

Equal fingerprints are one row from the start. Bits that go together are grouped into partitions. If two fingerprints differ in at
most ``reach`` bits, then for any thresholds t with sum ``reach - partitions + 1`` some partition i differs in at most t[i] bits (-1: is
not looked at). Each fingerprint takes the thresholds with the least estimated candidates, found by dynamic programming over
the counts of the partitions' values, probes the neighbourhoods they name, and every candidate is verified. Components need no more
than a spanning forest of the links, so a task gives on only those that join what it had not joined yet.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import map_batches, stored
from tessera.llm.components import components

SEED = 42
#: Bits of a partition's value by which candidates are counted: the driver holds at most 4 x 65536 counts.
COUNTED = 16


#: Rows of one value that a task takes; more are dealt over several.
CROWD = 20_000


def partitions_for(n: int, reach: int) -> int:
    """2, 3 or 4 partitions: the number with the fewest probes and candidates for a fingerprint, if values were even and thresholds near equal."""

    def price(parts: int) -> float:
        width, total = 64 // parts, 0.0
        for i in range(parts):
            t = (reach - parts + 1 + i) // parts  # thresholds of that sum
            ways = sum(comb(width, d) for d in range(t + 1))
            total += ways * (1 + n / 2.0**width)
        return total

    return min((2, 3, 4), key=lambda p: (price(p), -p))


def dealt(rows: DataFrame, most: int, *, pairs: bool) -> DataFrame:
    """``rows`` (slot, node, ...) with ``cell`` and ``block``: where a slot has more than ``most`` rows they are cut into blocks by a hash of node.

    With ``pairs`` every two blocks meet in a cell of their own (so a row goes to as many cells as its slot has blocks), else each block
    is a cell. A cell is i * 2**20 + j for blocks i <= j. The crowded slots are broadcast only if they are few.
    """
    crowded = stored(rows.groupBy("slot").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("slot", F.ceil(F.col("_n") / most).cast("long").alias("_blocks")), "crowded")
    many = crowded.count()
    if not many:
        return rows.withColumns({"cell": F.lit(0).cast("long"), "block": F.lit(0).cast("int")})
    joined = rows.join(F.broadcast(crowded) if many <= 1 << 16 else crowded, "slot", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    joined = joined.withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    place = lambda i, j: F.shiftleft(i.cast("long"), 20) + j
    if not pairs:
        return joined.withColumn("cell", place(F.col("block"), F.col("block"))).drop("_blocks")
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda j: place(F.least(j, F.col("block").cast("long")), F.greatest(j, F.col("block").cast("long"))))
    return joined.withColumn("cell", F.explode(cells)).drop("_blocks")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles; 0 without words. Unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1]
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65_536):
        cut = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65_536].tolist(), ends[shingle - 1 :][at : at + 65_536].tolist())]
        total += np.unpackbits(np.array(cut, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def make():
        return lambda keys, texts: {"doc_id": keys, "fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    return map_batches(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long", make)


def bit_groups(fps: DataFrame, parts: int = 4) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of about equal size, correlated bits together: greedy from the pair that goes together most.

    Needs the sums of bits and of products of bits over all rows: 65 x 64 numbers from each task.
    """

    def make():
        def step(values):
            x = _bits(np.array(values, np.int64))
            rows = np.vstack([x.T @ x, x.sum(0)]) if len(values) else np.zeros((65, 64))
            return {"i": [i for i in range(65) for _ in range(64)] + [-1] * 64, "j": list(range(64)) * 66, "s": [int(v) for v in rows.ravel()] + [len(values)] * 64}

        return step

    sums = map_batches(fps, ["fp"], "i int, j int, s long", make).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    table = np.zeros((66, 64))
    for r in sums:
        table[r.i, r.j] = r.s
    n = max(1.0, table[65, 0])
    mean = table[64] / n
    cov = table[:64] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return correlated_groups(np.abs(cov / np.outer(sd, sd)), parts)


def correlated_groups(tie: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of about equal size, greedily from the pair that goes together most."""
    tie = tie.copy()
    np.fill_diagonal(tie, -1.0)
    free, groups = np.ones(len(tie), bool), []
    for i in range(parts):
        left = np.flatnonzero(free)
        width = -(-len(left) // (parts - i))
        sub = tie[np.ix_(left, left)]
        group = [int(left[k]) for k in np.unravel_index(int(sub.argmax()), sub.shape)][:width]
        free[group] = False
        near = tie[:, group].sum(1)
        while len(group) < width:
            x = int(np.where(free, near, -np.inf).argmax())
            group.append(x)
            free[x] = False
            near = near + tie[:, x]
        groups.append(sorted(group))
    return groups


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)


def _values(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Each fingerprint's value in each partition: rows x partitions."""
    u = fps.view(np.uint64)
    return np.stack([sum(((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(g)) for g in groups], 1).astype(np.int64)


def ball_counts(counts: np.ndarray, radius: int, bits: int = COUNTED) -> np.ndarray:
    """``counts[v]`` by value of ``bits`` bits -> rows 0..radius: how many rows have values within that many bits of v."""
    at = np.arange(1 << bits)
    exact = [counts.astype(np.float64)]
    for d in range(1, radius + 1):
        around = sum(exact[d - 1][at ^ (1 << b)] for b in range(bits))
        exact.append((around - (bits - d + 2) * exact[d - 2]) / d if d > 1 else around)
    return np.cumsum(exact, 0)


def allocate(costs: np.ndarray, reach: int) -> np.ndarray:
    """``costs``: rows x partitions x k, the cost of thresholds -1..k - 2. Returns the thresholds, rows x partitions.

    Dynamic programming over the partitions and the sum of (threshold + 1) spent so far; the sum must be ``reach + 1``.
    """
    n, need = len(costs), reach + 1
    best = np.full((n, need + 1), np.inf, costs.dtype)
    best[:, 0], choice = 0, []
    for i in range(costs.shape[1]):
        after, taken = np.full((n, need + 1), np.inf, costs.dtype), np.zeros((n, need + 1), np.int8)  # by what is spent with this partition
        for here in range(costs.shape[2]):
            option = best[:, : need + 1 - here] + costs[:, i, here : here + 1]
            better = option < after[:, here:]
            after[:, here:][better], taken[:, here:][better] = option[better], here
        choice.append(taken)
        best = after
    out, left = np.empty((n, costs.shape[1]), np.int64), np.full(n, need)
    for i in range(costs.shape[1] - 1, -1, -1):
        here = choice[i][np.arange(n), left].astype(np.int64)
        out[:, i], left = here - 1, left - here
    return out


def _masks(width: int, radius: int) -> list[np.ndarray]:
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), d)], np.int64) for d in range(radius + 1)]


def links(distinct: DataFrame, reach: int = 3, *, parts: int | None = None, forest: bool = False) -> DataFrame:
    """(a, b), a < b: pairs of the distinct values ``fp`` that differ in at most ``reach`` bits.

    All of them, or with ``forest`` enough of them to connect whatever they connect.
    """
    spark, parts = distinct.sparkSession, parts or partitions_for(distinct.count(), reach)
    groups = bit_groups(distinct, parts)
    least = 1 << COUNTED

    def index():
        def step(values):
            v = _values(np.array(values, np.int64), groups) if values else np.zeros((0, parts), np.int64)
            return {"slot": (v + (np.arange(parts, dtype=np.int64) << 32)).ravel(), "fp": np.repeat(np.array(values, np.int64), parts)}

        return step

    indexed = map_batches(distinct, ["fp"], "slot long, fp long", index)
    low = (F.shiftright("slot", 32) * least + F.col("slot").bitwiseAND(least - 1)).cast("int")
    counts = np.zeros((parts, least))
    for slot, n in zip(*indexed.groupBy(low.alias("slot")).agg(F.count("*").alias("n")).toPandas().to_numpy().T.tolist() or ((), ())):  # at most parts x 65536 rows
        counts[slot >> COUNTED, slot & (least - 1)] = n
    shared = spark.sparkContext.broadcast(counts)

    def probe():
        # the price of a threshold: its candidates, and a little for every probe itself; counts of a part of the value are spread over the rest
        masks = [_masks(len(g), min(reach, len(g))) for g in groups]
        price = []
        for g, c in zip(groups, shared.value):
            ways, counted = np.cumsum([comb(len(g), d) for d in range(reach + 1)]), np.cumsum([comb(COUNTED, d) for d in range(reach + 1)])
            near = ball_counts(c, reach) * (ways / counted / 2.0 ** (len(g) - COUNTED))[:, None]
            price.append(np.vstack([np.zeros(least), near + 0.25 * ways[:, None]]))

        def step(values):
            fps = np.array(values, np.int64)
            v = _values(fps, groups) if values else np.zeros((0, parts), np.int64)
            costs = np.stack([p[:, v[:, i] & (least - 1)].T for i, p in enumerate(price)], 1) if values else np.zeros((0, parts, reach + 2))
            t = allocate(costs, reach)
            slots, keys = [], []
            for i in range(parts):
                for d in range(reach + 1):
                    rows = np.flatnonzero(t[:, i] >= d)
                    slots.append((v[rows, i][:, None] ^ masks[i][d]).ravel() + (i << 32))
                    keys.append(np.repeat(fps[rows], len(masks[i][d])))
            return {"slot": np.concatenate(slots), "fp": np.concatenate(keys)}

        return step

    probes = map_batches(distinct, ["fp"], "slot long, fp long", probe)
    # a crowded slot is cut into blocks of its index rows; its probes go to all of them
    crowded = stored(indexed.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("slot", F.ceil(F.col("n") / CROWD).cast("int").alias("blocks")), "crowded")
    many = crowded.count()
    zero, kind = F.lit(0), lambda k: F.lit(k).cast("byte").alias("kind")
    if many:
        crowded = F.broadcast(crowded) if many <= 1 << 16 else crowded
        indexed = indexed.join(crowded, "slot", "left").select("slot", "fp", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
        probes = probes.join(crowded, "slot", "left").select("slot", "fp", F.explode(F.sequence(zero, F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
    else:
        indexed, probes = indexed.withColumn("block", zero), probes.withColumn("block", zero)
    both = indexed.select("slot", "block", "fp", kind(0)).unionByName(probes.select("slot", "block", "fp", kind(1)))
    out = StructType([StructField("a", LongType()), StructField("b", LongType())])
    dealt_rows = both.repartition("slot", "block").sortWithinPartitions("slot", "block", "kind")
    cell = (F.shiftleft("slot", 20) + F.col("block")).alias("cell")
    found = dealt_rows.select(cell, "fp", "kind").mapInArrow(_verify(reach, forest), out)
    return found if forest else found.distinct()


def _verify(reach: int, forest: bool):
    """Over rows in order of slot, each slot's index rows before its probes: the pairs within ``reach`` bits.

    Only the index rows of the slot at hand are kept from batch to batch; pairs are made and tested in blocks of bounded size.
    """
    block = 1 << 20

    def run(batches):
        slot_at, held, parent = None, np.zeros(0, np.int64), {}

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        def fresh(a, b):
            for x, y in np.unique(np.stack([a, b], 1), axis=0).tolist():
                if not forest:
                    yield x, y
                elif (p := root(x)) != (q := root(y)):
                    parent[max(p, q)] = min(p, q)
                    yield x, y

        for batch in batches:
            slot, fp, kind = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(slot):
                continue
            if slot[0] == slot_at:  # the slot goes on: what it has kept stands before the batch
                slot, fp, kind = np.concatenate([np.full(len(held), slot_at), slot]), np.concatenate([held, fp]), np.concatenate([np.zeros(len(held), kind.dtype), kind])
            own = np.flatnonzero(kind == 0)
            asks = np.flatnonzero(kind == 1)
            lo, hi = (np.searchsorted(slot[own], slot[asks], side=s) for s in ("left", "right"))
            n, pairs = hi - lo, []
            ends = np.cumsum(n)
            for at in range(0, int(ends[-1]) if len(ends) else 0, block):
                k = np.arange(at, min(at + block, int(ends[-1])))
                q = np.searchsorted(ends, k, side="right")
                a, b = fp[asks[q]], fp[own[lo[q] + k - (ends[q] - n[q])]]
                ok = (a < b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= reach)
                pairs += fresh(a[ok], b[ok])
            if len(parent) > 1 << 20:  # some links may then be told twice
                parent.clear()
            slot_at = slot[-1]
            held = fp[own[slot[own] == slot_at]]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 3, reach: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links reach) for every row.

    Null and empty texts have fingerprint 0 and are linked like others. A row without doc_id takes part with its fingerprint; a component
    of such rows alone has a null id. Repeated rows stay; an empty table stays empty; other columns are ignored.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes.select("fp"), reach, forest=True)).withColumnRenamed("node", "fp")
    rooted = stored(classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    sizes = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "sizes")
    # a component may hold a third of all fingerprints: the few that large are looked up by broadcast, all others by a join
    large = F.broadcast(sizes.where(F.col("n") > max(100, classes.count() // 200)).drop("n"))  # 200 rows at most
    of = rooted.join(large, "root").unionByName(rooted.join(large, "root", "left_anti").join(sizes.drop("n"), "root")).select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs``, with all columns, of each component: that with the least doc_id. Rows without doc_id stay."""
    found = near_duplicates(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
