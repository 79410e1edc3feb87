"""Reviews of cases as a state machine: requested moves are accepted or refused by the case's state and the person's role, and each accepted
move leaves a snapshot. One function decides for streams and for tables.

A stream keeps each case's state in the state store (RocksDB), so a restarted query goes on where its checkpoint ends. A case's requests
of one batch are taken in the order of time and id; a request that arrives in a later batch than a younger one is taken when it arrives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a move gives: the case's status before and after, whether it was accepted or why not, and the number of snapshots so far.
OUT = "event_id long, at timestamp, old_status string, new_status string, outcome string, snapshot long"


@dataclass(frozen=True)
class Review:
    """``initial`` is the status of a case without events. ``only_from`` names the statuses from which one may be reached (others: from any),
    ``roles`` the roles that may ask for it (others: any but ``readers``); ``final`` statuses are never left."""

    initial: str = "uploaded"
    only_from: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"archived": ("approved", "rejected")})
    roles: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"archived": ("ADMIN",), "approved": ("ADMIN",)})
    readers: tuple[str, ...] = ("VIEWER",)
    final: tuple[str, ...] = ("archived",)

    def outcome(self, status: str, asked: str | None, role: str | None) -> str:
        """accepted, unchanged, or the first reason against the move: final, role, move, unknown (no status asked for)."""
        if status in self.final:
            return "final"
        if asked is None:
            return "unknown"
        if asked == status:
            return "unchanged"
        if role in self.readers or role not in self.roles.get(asked, (role,)):
            return "role"
        return "accepted" if status in self.only_from.get(asked, (status,)) else "move"

    def walk(self, events: pd.DataFrame, status: str, snapshot: int) -> tuple[pd.DataFrame, str, int]:
        """The outcome of each of one case's events, in order, and its status and snapshots after them."""
        out = []
        for e in events.sort_values(["at", "event_id"]).itertuples(index=False):
            old, said = status, self.outcome(status, e.asked, e.role)
            if said == "accepted":
                status, snapshot = e.asked, snapshot + 1
            out.append((e.event_id, e.at, old, status, said, snapshot))
        return pd.DataFrame(out, columns=["event_id", "at", "old_status", "new_status", "outcome", "snapshot"]), status, snapshot


class _Case(StatefulProcessor):
    def __init__(self, review: Review, key: str):
        self.review, self.key = review, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.case = handle.getValueState("case", "status string, snapshot long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        status, snapshot = self.case.get() if self.case.exists() else (self.review.initial, 0)
        got, status, snapshot = self.review.walk(pd.concat(list(rows)), status, snapshot)
        self.case.update((status, snapshot))
        got.insert(0, self.key, key[0])
        yield got

    def close(self) -> None:
        pass


def reviewed(events: DataFrame, key: str, review: Review = Review()) -> DataFrame:  # noqa: B008
    """``key`` and the columns of ``OUT`` for every event (``key``, event_id, at, asked, role) of a table or a stream; other columns are not looked at.

    A table's cases start from ``review.initial``; a case's events must fit into one task's memory, other cases share nothing with it. Streams
    need ``spark.sql.streaming.stateStore.providerClass`` to name the RocksDB provider (``ROCKS``). Null keys are one case, null times come last.
    """
    rows = events.select(key, F.col("event_id").cast("long").alias("event_id"), "at", "asked", "role")
    schema = f"{key} {events.schema[key].dataType.simpleString()}, {OUT}"
    if events.isStreaming:
        return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=_Case(review, key), outputStructType=schema, outputMode="Append", timeMode="None")

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        got, _, _ = review.walk(part, review.initial, 0)
        got.insert(0, key, part[key].iloc[0])
        return got

    return rows.groupBy(key).applyInPandas(whole, schema)


def upsert_new(spark: SparkSession, incoming: DataFrame, path: str, checkpoint: str, keys: list[str], *order) -> StreamingQuery:
    """Rows of a stream whose ``keys`` the Parquet table at ``path`` lacks, the first of each key in ``order``, appended; all that is there, then stop.

    Every batch writes to a folder named by its id, in place of what a failed try left there, and looks for known keys in the folders
    of other batches only: a batch that is run again, with the same rows, gives the same rows and adds nothing twice. Null keys are left out.
    """
    from tessera.operators.store import latest

    kinds = incoming.schema

    def write(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        rows = latest(batch.na.drop(subset=keys), keys, *order)
        known = s.read.schema(_with_batch(kinds)).parquet(path) if _there(s, path) else None
        if known is not None:
            rows = rows.join(known.where(F.col("batch") != number).select(*keys).distinct(), keys, "left_anti").select(*kinds.names)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return incoming.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _with_batch(kinds):
    from pyspark.sql import types as T

    return T.StructType([*kinds.fields, T.StructField("batch", T.LongType())])


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
