"""An extension: contracts that arrive as files, assessed as they come; the log of workflow events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import obligations, segments
from tessera.packs import OBLIGATIONS, ObligationPack


def assessed_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", *, pack: ObligationPack = OBLIGATIONS, files_per_trigger: int = 100) -> DataFrame:
    """Clauses (lines) of Parquet documents under ``path`` with their assessment."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return obligations.assess(segments.lines(docs), text="line", pack=pack)


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there, then stop; a restart goes on where the checkpoint ends."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Workflow events by window and type; later ones than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "event_type", "n")
