"""Token-ID / binary output (7): ids of every document in ascending order of doc_id, in Simple-8b segments.

A data set is a Parquet folder whose rows are segments of whole documents: ``part`` and ``seq`` (their order), ``begin`` (ids
of the part before the segment), ``n_ids``, ``doc_ids`` (int64), ``lengths`` (uint32, ids of each document), ``offsets``
(uint32, first word of each block; every document begins a block), ``escapes`` and ``words`` (uint64), all little-endian. Spark's
own writer commits the parts, so a task that is lost is written again whole.

Documents are encoded where they are read; what is shuffled are their coded words, a third of a text's bytes or so. The parts are
ranges of doc_id with about as many rows each, by quantiles of that column alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm import simple8b
from tessera.llm.pieces import worker_table
from tessera.llm.token_counts import default_tokenizer


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SEGMENT = _struct(part=T.IntegerType(), seq=T.IntegerType(), begin=T.LongType(), n_ids=T.LongType(), n_null=T.IntegerType(), **{n: T.BinaryType() for n in ("doc_ids", "lengths", "offsets", "escapes", "words")})
CODED = _struct(part=T.IntegerType(), doc_id=T.LongType(), n_ids=T.IntegerType(), **{n: T.BinaryType() for n in ("offsets", "escapes", "words")})
#: Ids at which a segment is closed; it never ends inside a document.
SEGMENT_IDS = 1 << 18
#: Ids, and coded rows, that a worker holds at once besides one document.
HELD_IDS, HELD_ROWS = 1 << 18, 512
#: Parts at most: their bounds are one list of doc_ids on the driver.
MOST_PARTS = 16_384


def _packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


def _cut(array: np.ndarray, ends: np.ndarray, kind: str) -> list[bytes]:
    starts = np.concatenate([[0], ends[:-1]])
    return [array[a:b].astype(kind).tobytes() for a, b in zip(starts.tolist(), ends.tolist())]


def _coded(keys: list, blobs: list[bytes], bounds: np.ndarray, arrow: pa.Schema) -> pa.RecordBatch:
    """A row for every document: its words, the offsets of its blocks among them, and its escapes, which its words number from 0."""
    lengths = np.array([len(b) // 4 for b in blobs], np.int64)
    words, offsets, escapes = simple8b.encode(np.frombuffer(b"".join(blobs), "<u4"), lengths)
    blocks = np.cumsum(simple8b.blocks_of(lengths))
    word_ends = np.append(offsets, len(words)).astype(np.int64)[blocks]
    escaped = np.flatnonzero(words >> np.uint64(60) == 0)
    escape_ends = np.searchsorted(escaped, word_ends)
    starts, first = np.concatenate([[0], word_ends[:-1]]), np.concatenate([[0], escape_ends[:-1]])
    if len(escaped):
        words[escaped] -= first[np.searchsorted(word_ends, escaped, side="right")].astype(np.uint64)
    inside = offsets.astype(np.int64) - np.repeat(starts, simple8b.blocks_of(lengths))
    part = [0 if k is None else int(np.searchsorted(bounds, k, side="left")) for k in keys]
    row = [part, keys, lengths, _cut(inside, blocks, "<u4"), _cut(escapes, escape_ends, "<u8"), _cut(words, word_ends, "<u8")]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, arrow)], schema=arrow)


def encode_documents(docs: DataFrame, bounds: np.ndarray, *, tokenizer: str, end_id: int) -> DataFrame:
    """The coded rows of ``docs`` and the part, among those that ``bounds`` separate, to which each belongs."""
    arrow, end = to_arrow_schema(CODED), _packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table("ids", tokenizer, _packed, lambda a, b: a + b)
        for batch in batches:
            keys, blobs, held = [], [], 0
            for i in range(batch.num_rows):
                first, rest = table.of(batch.column(1)[i].as_py())
                keys.append(batch.column(0)[i].as_py())
                blobs.append(b"".join([first, *rest, end]))
                held += len(blobs[-1]) // 4
                if held >= HELD_IDS:
                    yield _coded(keys, blobs, bounds, arrow)
                    keys, blobs, held = [], [], 0
            if keys:
                yield _coded(keys, blobs, bounds, arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CODED)


def _segment(part: int, seq: int, begin: int, rows: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    words, blocks, escapes = ([np.frombuffer(r[n], k) for r in rows] for n, k in (("words", "<u8"), ("offsets", "<u4"), ("escapes", "<u8")))
    n_words, n_escapes = (np.cumsum([0, *map(len, x)]) for x in (words, escapes))
    if n_escapes[-1]:
        words = [np.where(w >> np.uint64(60) == 0, w + np.uint64(k), w) for w, k in zip(words, n_escapes.tolist())]
    offsets = np.concatenate([b + k for b, k in zip(blocks, n_words.tolist())]).astype("<u4")
    lengths = np.array([r["n_ids"] for r in rows], "<u4")
    keys = np.array([r["doc_id"] or 0 for r in rows], "<i8")
    # rows without doc_id come first, so their number tells which they are
    row = [part, seq, begin, int(lengths.sum()), sum(r["doc_id"] is None for r in rows), *(x.tobytes() for x in (keys, lengths, offsets, np.concatenate(escapes), np.concatenate(words)))]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 0, parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path``.

    Parts are ranges of doc_id, as many as shuffle partitions or, where more, as splits of ``docs``, which follow its bytes. doc_id is a whole number; another
    type is cast to one, as the session casts. A null or empty text gives the end id alone. Rows without doc_id come first; repeated ids stand side by side, in the order
    of their number of ids and coded words. An empty table writes an empty data set. Other columns are not looked at.
    """
    parts = parts or min(MOST_PARTS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    arrow = to_arrow_schema(SEGMENT)
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, begin, rows, held = None, 0, 0, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, HELD_ROWS):
                for row in batch.slice(at, HELD_ROWS).to_pylist():
                    if row["part"] != part:
                        if rows:
                            yield _segment(part, seq, begin, rows, arrow)
                        part, seq, begin, rows, held = row["part"], 0, 0, [], 0
                    rows.append(row)
                    held += row["n_ids"]
                    if held >= SEGMENT_IDS:
                        yield _segment(part, seq, begin, rows, arrow)
                        seq, begin, rows, held = seq + 1, begin + held, [], 0
        if rows:
            yield _segment(part, seq, begin, rows, arrow)

    coded = encode_documents(docs, bounds, tokenizer=tokenizer or default_tokenizer(), end_id=end_id)
    ordered = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "n_ids", "words")
    ordered.mapInArrow(run, SEGMENT).write.option("compression", "none").parquet(path)


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """part -> ids in the parts before it; one number a part comes to the driver."""
    sums = spark.read.schema(SEGMENT).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, total = {}, 0
    for r in sums:
        starts[r.part] = total
        total += r.n
    return starts


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32, and ``ids`` if asked for."""
    starts = spark.sparkContext.broadcast(part_starts(spark, path))
    out = T.StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a segment at a time, its columns without a copy
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                part, begin = row["part"].as_py(), row["begin"].as_py()
                keys, lengths, offsets, escapes, words = (np.frombuffer(row[n].as_buffer(), k) for n, k in (("doc_ids", "<i8"), ("lengths", "<u4"), ("offsets", "<u4"), ("escapes", "<u8"), ("words", "<u8")))
                lengths = lengths.astype(np.int64)
                ids = simple8b.decode(words, offsets, escapes, lengths).astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                got = [pa.array(keys, mask=np.arange(len(keys)) < row["n_null"].as_py()), pa.array(ends - lengths + begin + starts.value[part]), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    got.append(pa.array([ids[e - n : e].astype(np.int64) for e, n in zip(ends, lengths)], arrow.field("ids").type))
                yield pa.RecordBatch.from_arrays(got, schema=arrow)

    return spark.read.schema(SEGMENT).parquet(path).mapInArrow(run, out)
