"""Streamed reviews and idempotent inserts, stopped and restarted, against the table's result."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import review as R

STATES = ("uploaded", "in_review", "approved", "rejected", "archived")
ROLES = ("ADMIN", "ANALYST", "VIEWER", None)


def some_events(n, seed=1):
    r = random.Random(seed)
    return [(r.randint(1, 9), i, datetime(2026, 1, 1) + timedelta(minutes=i // 2), r.choice((*STATES, None)), r.choice(ROLES)) for i in range(n)]


COLUMNS = "case_id long, event_id long, at timestamp, asked string, role string"


def by_hand(events):
    state, out = {}, []
    for c, i, at, asked, role in sorted(events, key=lambda e: (e[2], e[1])):
        old, n = state.get(c, ("uploaded", 0))
        if old == "archived":
            said = "final"
        elif asked is None:
            said = "unknown"
        elif asked == old:
            said = "unchanged"
        elif role == "VIEWER" or (asked in ("approved", "archived") and role != "ADMIN"):
            said = "role"
        elif asked == "archived" and old not in ("approved", "rejected"):
            said = "move"
        else:
            said = "accepted"
        state[c] = (asked, n + 1) if said == "accepted" else (old, n)
        out.append((c, i, at, old, state[c][0], said, state[c][1]))
    return sorted(out)


def rows(df):
    return sorted((r.case_id, r.event_id, r.at, r.old_status, r.new_status, r.outcome, r.snapshot) for r in df.collect())


def test_table(spark):
    events = some_events(400)
    assert rows(R.reviewed(spark.createDataFrame([(*e, "x") for e in events], COLUMNS + ", status string"), "case_id")) == by_hand(events)
    assert {r[5] for r in by_hand(events)} == {"accepted", "unchanged", "final", "role", "move", "unknown"}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, R.ROCKS)
    yield
    spark.conf.unset(name)


def test_stream_with_a_restart_equals_the_table(spark, rocks, tmp_path):
    events = some_events(240, seed=4)
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def arrive(part):
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(source)
        R.reviewed(stream, "case_id").writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    arrive(events[:80])
    run()
    arrive(events[80:160])
    run()  # a new query on the old checkpoint
    arrive(events[160:])
    run()
    got = rows(spark.read.parquet(target))
    assert got == by_hand(events) == rows(R.reviewed(spark.createDataFrame(events, COLUMNS), "case_id"))


def test_inserts_are_idempotent(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    made = lambda ids, tag: spark.createDataFrame([(i % 7 if i else None, i, tag) for i in ids], "gap long, n long, tag string")

    def run():
        stream = spark.readStream.schema("gap long, n long, tag string").option("maxFilesPerTrigger", 1).parquet(source)
        R.upsert_new(spark, stream, target, checkpoint, ["gap"], F.col("n")).awaitTermination()

    made(range(0, 4), "a").coalesce(1).write.mode("append").parquet(source)
    run()
    made(range(2, 30), "b").coalesce(1).write.mode("append").parquet(source)
    run()
    want = [(1, 1, "a"), (2, 2, "a"), (3, 3, "a"), (0, 7, "b"), (4, 4, "b"), (5, 5, "b"), (6, 6, "b")]
    got = lambda: sorted((r.gap, r.n, r.tag) for r in spark.read.parquet(target).collect())
    assert got() == sorted(want)
    # the last batch is lost from the checkpoint's log of finished ones, as by a kill between its write and its commit: it runs again
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert got() == sorted(want)
