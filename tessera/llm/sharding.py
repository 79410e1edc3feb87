"""Sharding (9): sampled splitters over a hash of the text, sizes near equal, groups of equal texts whole where they fit.

Size-weighted samples of the key give quantile boundaries; records are range-partitioned by them into many more ranges than
shards, and overfull ranges are subdivided. Exact sizes of the ranges (one row a range) then decide which shard each takes.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored


def _records(docs: DataFrame) -> DataFrame:
    """Fixed-width rows with a number each, to be stored at once; equal texts have equal keys."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.monotonically_increasing_id().alias("row"))


def splitters(records: DataFrame, total: int, *, samples: int, ranges: int) -> list[int]:
    """At most ``ranges - 1`` keys: quantiles of about ``samples`` keys drawn with odds in proportion to size."""
    draw = F.pmod(F.xxhash64(F.lit("draw"), "row"), F.lit(1 << 40)) / float(1 << 40)
    drawn = records.where(draw < F.col("size") * (samples / max(total, 1))).select("key")
    # each record enters once at most, so at most 2 * samples keys but for chance
    keys = sorted(r.key for r in drawn.collect())
    cuts = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    # a key that is several quantiles at once gets a range of its own
    return sorted({*cuts, *(a + 1 for a, b in zip(cuts, cuts[1:]) if a == b and a < (1 << 63) - 1)})


def assign(ranges: list[tuple], shards: int) -> dict:
    """(range, bytes) in key order -> shard. Heavy ranges go first, to the emptiest shard; the others fill what is left in order."""
    total = sum(b for _, b in ranges)
    goal = total / shards
    heavy = [x for x in ranges if x[1] > goal / 64]
    load, out = [0] * shards, {}
    for r, b in sorted(heavy, key=lambda x: (-x[1], x[0])):
        s = min(range(shards), key=lambda i: (load[i], i))
        out[r], load[s] = s, load[s] + b
    # the rest in order, by the room that each shard has left
    room = [max(0.0, goal - x) for x in load]
    light, scale = [x for x in ranges if x[0] not in out], sum(b for _, b in ranges if _ not in out) / max(sum(room), 1e-9)
    ends = np.cumsum([x * scale for x in room]).tolist()
    done = 0
    for r, b in light:
        out[r] = min(shards - 1, bisect.bisect_left(ends, done + b / 2))
        done += b
    return out


def shard_documents(docs: DataFrame, *, shards: int = 8, samples: int = 40_000, ranges: int = 2048) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``bytes``. A null text has size 1 and shares a group with empty texts. A range whose exact size is over twice its share is
    subdivided: by key where it holds several; one group of copies of more than half a shard's share by a hash of its rows' numbers, so
    rows that are equal in everything, or without id, are cut like others. An empty table stays empty.
    """
    records = stored(_records(docs), "records")
    total = records.agg(F.sum("size")).first()[0] or 0
    cuts = np.array(splitters(records, total, samples=samples, ranges=ranges), np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

    ranged = records.withColumn("range", range_of("key"))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("key").alias("k0"), F.max("key").alias("k1")).collect()
    share = total / max(1, ranges)
    # overfull ranges: by key into as many parts as they need; one key too large for a shard is cut by its rows
    over = {r.range: (int(r.b // share) + 1, r.k0 == r.k1 and r.b > total / shards / 2) for r in sums if r.b > 2 * share}
    parts = F.lit(1)
    by_tie = F.lit(False)
    if over:
        known = F.create_map(*[F.lit(x) for k, (p, _) in over.items() for x in (k, p)])
        parts = F.coalesce(F.element_at(known, F.col("range")), F.lit(1))
        tied = [k for k, (_, t) in over.items() if t]
        by_tie = F.col("range").isin(tied) if tied else by_tie
    # a second hash of the key spreads its range's groups, and keeps each whole
    sub = F.pmod(F.when(by_tie, F.xxhash64(F.lit("sub"), "row")).otherwise(F.xxhash64(F.lit("part"), "key")), parts).cast("int")
    placed = ranged.withColumn("part", sub)
    cells = placed.groupBy("range", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("range", "part").collect()
    shard = assign([((c.range, c.part), c.b) for c in cells], shards)
    start, seen = {}, [0] * shards
    for c in cells:
        s = shard[c.range, c.part]
        start[c.range, c.part] = seen[s]
        seen[s] += c.n
    spark = docs.sparkSession
    plan = spark.createDataFrame([(c.range, c.part, shard[c.range, c.part], start[c.range, c.part], (c.n + 65_535) // 65_536) for c in cells], "range int, part int, shard int, start long, blocks long")
    joined = placed.join(F.broadcast(plan), ["range", "part"])
    return _slots(joined).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slots(placed: DataFrame) -> DataFrame:
    """Gapless slots: a cell of many rows is numbered in blocks of a hash of the row's number, each block behind the ones before it."""
    blocked = placed.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "row"), F.col("blocks")).cast("int"))
    sizes = blocked.where("blocks > 1").groupBy("range", "part", "block").agg(F.count("*").alias("n"))
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(W.partitionBy("range", "part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rows = blocked.join(F.broadcast(ahead), ["range", "part", "block"], "left")
    order = W.partitionBy("range", "part", "block").orderBy("key", "doc_id", "row")
    return rows.withColumn("slot", F.col("start") + F.coalesce("ahead", F.lit(0)) + F.row_number().over(order) - 1)
