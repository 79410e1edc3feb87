"""Alignment of two tokenizers (12): minimal groups of tokens that cover the same bytes, links between them, and corpus-wide counts of links.

Tokens of both tokenizers are the two sides of a graph whose links are overlaps of their byte ranges; union-find gives its connected
components, which are the minimal groups: between two components both sides end at the same byte. Texts are cut before lone spaces between
other characters first. Both sides end there (neither vocabulary has a token that goes across, which is checked), so a
component never spans the cut, and the components of a piece are found once and kept by the worker.

Links of each text are expanded from the components' members and stored as (pair, times). One aggregation with map-side combine counts
pairs over the corpus. The frequent pairs (at most ``table_entries``) go back to the texts by broadcast, all others by a join on the
pair, so a frequent pair is no join key and a rare one meets few rows.
"""

from __future__ import annotations

import operator
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import stored
from tessera.llm.pieces import _BYTES, _CUT, CACHE_CHARS

#: Pieces that a worker keeps; at this number it begins anew.
KEPT_PIECES = 400_000
#: Pieces that are encoded as one text.
PIECES_AT_ONCE = 2_000
#: Texts that are cut and encoded at once.
TEXTS_AT_ONCE = 256
#: Rows whose pairs are looked up at once.
ROWS_AT_ONCE = 1_000
_UNEVEN = re.compile(r"\A\s|\s\Z| \s|\s |\A\Z")
_FIRST, _SECOND, _THIRD = map(operator.itemgetter, range(3))


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of every token of either side, numbered in text order, in the graph whose links are overlaps.

    Both sides cover the same bytes; ``*_ends`` are end offsets, ascending. Union-find by whole arrays: every set hooks itself to the least
    set that a link shows it, then every node takes its root, until no link joins two sets.
    """
    n = len(a_ends)
    cuts = np.union1d(a_ends, b_ends)  # bytes between two ends belong to one token of each side: these two overlap
    left, right = np.searchsorted(a_ends, cuts), n + np.searchsorted(b_ends, cuts)
    parent = np.arange(n + len(b_ends))
    while True:
        p, q = parent[left], parent[right]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    # roots are the least node of a component, which is its first token of the first side: ascending in text order
    numbers = np.searchsorted(np.unique(parent), parent)
    return numbers[:n], numbers[n:]


class Aligner:
    """Texts to tokens' counts, groups and links, by the two libraries and ``components``; what a piece gave is kept."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        signs = {chr(c) if isinstance(c, int) else c: b for b, c in _BYTES.items()}
        plain = lambda t: bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode()
        self.a_bytes = [plain(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        # a token that holds a space behind another character that is no white space would go across a cut: then texts are taken whole
        self.cuts = not any(re.search(r"\S ", t.decode(errors="replace")) for t in (*self.a_bytes, *self.b_bytes))
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        self.texts = np.array([[f"{i}{sign}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))] for sign in (",", "|", ";", "")], object)
        #: piece -> (n_a << 32 | n_b, groups, links as bytes), or None where the tokens' bytes are not the piece's
        self.kept: dict[str, tuple[int, str, bytes] | None] = {}

    def cut(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of either side where both give the bytes of a space and the text."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = b" " + text.encode()
        return (a, b) if b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b]) else None

    def values(self, pieces: list[str], a: list[int], b: list[int]) -> list[tuple[int, str, bytes]]:
        """What is kept of every piece, from the ids of the pieces with a space before each, one behind the other."""
        ids_a, ids_b = np.array(a), np.array(b)
        a_ends, b_ends = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
        upto_a, upto_b = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1  # tokens up to each piece's end
        of_a, of_b = components(a_ends, b_ends)
        n = of_a[-1] + 1
        last_a, last_b = np.searchsorted(of_a, np.arange(n), "right") - 1, np.searchsorted(of_b, np.arange(n), "right") - 1
        # of a component's members the last ones end together, and no others do
        links = (ids_a[last_a] << 32 | ids_b[last_b]).astype("<i8").tobytes()
        # ids in the order of groups, those of the first side before those of the second, each with the sign that follows it
        order = np.argsort(np.concatenate((2 * of_a, 2 * of_b + 1)), kind="stable")
        sign = np.zeros(len(order), np.int64)
        sign[last_a], sign[len(ids_a) + last_b] = 1, 2
        sign[len(ids_a) + upto_b - 1] = 3
        text = self.texts[sign[order], np.concatenate((ids_a, ids_b))[order]].tolist()
        counts = np.diff(upto_a, prepend=0) << 32 | np.diff(upto_b, prepend=0)
        out, begin, first = [], 0, 0
        for c, end, last in zip(counts.tolist(), (upto_a + upto_b).tolist(), (8 * (of_a[upto_a - 1] + 1)).tolist()):
            out.append((c, "".join(text[begin:end]), links[first:last]))
            begin, first = end, last
        return out

    def learn(self, pieces: set[str]) -> None:
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        new = [p for p in pieces if p not in self.kept]
        # pieces that could be cut out of one text are encoded as one, the others each by itself
        even = [p for p in new if self.cuts and not _UNEVEN.search(p) and "▁" not in p]
        for i in range(0, len(even), PIECES_AT_ONCE):
            part = even[i : i + PIECES_AT_ONCE]
            got = self.encode(" ".join(part))
            if got:
                self.kept.update(zip(part, self.values(part, *got)))
        for p in new:
            if p not in self.kept:
                got = self.encode(p)
                self.kept[p] = self.values([p], *got)[0] if got else None

    def aligned(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, groups, pairs, times) of every text."""
        cut = [self.cut(t) if t else [] for t in texts]
        pieces = set().union(*cut)
        self.learn(pieces)
        for text, parts in zip(texts, cut):
            values = list(map(self.kept.__getitem__, parts))
            if None in values:  # perhaps the libraries differ on the whole; they decide
                got = self.encode(text)
                values = self.values([text], *got) if got else []
            counts = sum(map(_FIRST, values))
            links = np.frombuffer(b"".join(map(_THIRD, values)), "<i8")
            pairs, times = np.unique(links, return_counts=True)
            yield counts >> 32, counts & 0xFFFFFFFF, len(links), ";".join(map(_SECOND, values)), pairs, times
        for p in pieces:
            if len(p) > CACHE_CHARS:
                self.kept.pop(p, None)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This Python worker's; later tasks find what earlier ones learned."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))


def align(docs: DataFrame, *, tokenizer_a: str | None = None, tokenizer_b: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, ``key``, n_a, n_b, n_groups, groups, pairs, times for every row of ``docs``.

    ``tokenizer_a`` is a byte-level vocabulary for the tokenizers library, which gets a space and the text; ``tokenizer_b`` a model for
    sentencepiece, which adds that space. ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of each group's tokens in text order. ``pairs``
    holds ``a << 32 | b`` of links (tokens that end at one byte), ``times`` how often each stands in the text; a pair may come several times. ``row``
    numbers the rows of one run, so store the result before it is read twice.

    Null and empty texts, and texts whose joined tokens are not the text's bytes (as by a literal U+2581), have no tokens: zeros, an empty
    string, empty lists. Repeated rows give repeated rows, null keys stay, an empty table gives an empty one; other columns are not looked at.
    """
    a, b = default_tokenizers()
    a, b = tokenizer_a or a, tokenizer_b or b
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("k", docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")), T.StructField("groups", T.StringType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "times"))])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        its, number = aligner(a, b), TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(begin, TEXTS_AT_ONCE)
                got = list(zip(*its.aligned(part.column(1).to_pylist())))
                rows = pa.array(np.arange(number, number + part.num_rows))
                number += part.num_rows
                longs = [pa.array(x, pa.int64()) for x in got[:3]]
                yield pa.RecordBatch.from_arrays([rows, part.column(0), *longs, pa.array(got[3], pa.string()), *(_lists(list(x), pa.int64()).cast(arrow.field(i).type) for i, x in ((6, got[4]), (7, got[5])))], schema=arrow)

    return docs.select(key, text).mapInArrow(run, out).withColumnRenamed("k", key)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n, best: how many links hold each pair over all rows of ``links`` (pairs, times), and whether no pair of its B id has more."""
    counted = stored(links.select(F.inline(F.arrays_zip("pairs", "times"))).toDF("pair", "t").groupBy("pair").agg(F.sum("t").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of one vocabulary
    return counted.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, table_entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted pairs, their n and best, for all pairs of at least the least power of two in n that leaves ``table_entries`` or fewer; and that number."""
    classes = {r.c: r.k for r in counts.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count("*").alias("k")).collect()}  # one row a power of two
    total, low = 0, max(classes, default=0) + 1
    while low > 0 and total + classes.get(low - 1, 0) <= table_entries:
        low -= 1
        total += classes.get(low, 0)
    t = counts.where(F.floor(F.log2("n")) >= low).orderBy("pair").toArrow()
    return t["pair"].to_numpy(), t["n"].to_numpy(), t["best"].to_numpy(), low


def with_link_counts(aligned: DataFrame, key: str = "doc_id", *, table_entries: int = 1 << 20) -> DataFrame:
    """Adds n_links, n_best, count_sum to the columns of ``aligned`` other than row, pairs and times.

    ``aligned`` is what ``align`` gives, with further columns if wanted. A link counts in n_best if its pair's count is the highest of
    its B id, ties included; count_sum adds the counts of all links. Rows without links have zeros.
    """
    rows = stored(aligned, "aligned")
    counts = stored(pair_counts(rows), "counts")
    pairs, n, best, low = frequent(counts, table_entries)
    shared = rows.sparkSession.sparkContext.broadcast((pairs, n, best))
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            p, t = (batch.column(batch.schema.names.index(c)) for c in ("pairs", "times"))
            of = np.repeat(np.arange(batch.num_rows), p.value_lengths().to_numpy(zero_copy_only=False))
            code, times = (x.flatten().to_numpy(zero_copy_only=False) for x in (p, t))
            at = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
            hit = pairs[at] == code if len(pairs) else np.zeros(len(code), bool)
            add = lambda x: np.bincount(of[hit], x[hit], batch.num_rows)
            # sums of whole numbers below 2^53 are exact in doubles; larger ones are added as integers
            sums = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, of[hit], (times[hit] * n[at[hit]]))
            good = np.zeros(len(code))
            good[hit] = times[hit] * best[at[hit]]
            links = np.bincount(of, times, batch.num_rows).astype(np.int64)
            miss = ~hit
            missed = [_lists(np.split(x[miss], np.cumsum(np.bincount(of[miss], minlength=batch.num_rows))[:-1]), pa.int64()) for x in (code, times)]
            columns = [batch.column(batch.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(links), pa.array(add(good).astype(np.int64)), pa.array(sums), *missed], names=[*kept, "n_links", "_best", "_sum", "_pairs", "_times"])

    out = T.StructType([*(aligned.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in ("n_links", "_best", "_sum")), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("_pairs", "_times"))])
    looked = rows.mapInArrow(run, out)
    if low <= 0:  # every pair was in the table
        return looked.select(*[c for c in kept if c != "row"], "n_links", F.col("_best").alias("n_best"), F.col("_sum").alias("count_sum"))
    looked = stored(looked, "looked")
    rest = looked.where(F.size("_pairs") > 0).select("row", F.inline(F.arrays_zip("_pairs", "_times"))).toDF("row", "pair", "t")
    rare = counts.where(F.floor(F.log2("n")) < low)
    added = rest.join(rare, "pair").groupBy("row").agg(F.sum(F.col("t") * F.col("best").cast("long")).alias("b2"), F.sum(F.col("t") * F.col("n")).alias("s2"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return looked.join(added, "row", "left").select(*[c for c in kept if c != "row"], "n_links", (F.col("_best") + zero("b2")).alias("n_best"), (F.col("_sum") + zero("s2")).alias("count_sum"))
