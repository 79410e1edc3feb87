"""Chunks under a token budget, with overlap, as joins and windows.

Which chunk a row falls into depends on the chunk before. But where a chunk ends decides alone how far back the next one reaches and where
that one ends, so every row can be asked "if a chunk ended here, where would the next one end?". Prefix sums of the token counts answer
this for all rows at once. Pointer doubling then follows the answers from the beginning of each document: after k rounds the ends of
its first 2^k chunks are known, so the rounds grow with the logarithm of the longest document's chunks. A round is one equi-join of rows by
document and place; no document is a group in one Python call.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.shared import stored

# A sentence ends at one of these signs, before white space and a capital or quotation mark.
SENTENCE = r'([.!?])\s+([A-ZÄÖÜ"])'
_MARK = "\x01"


@dataclass(frozen=True)
class Words:
    """Tokens are runs of characters between white space."""

    def list(self, text: Column) -> Column:
        return F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def count(self, text: Column) -> Column:
        return F.size(self.list(text))

    def cut(self, text: Column, most: int) -> Column:
        """The text in parts of at most ``most`` tokens."""
        parts = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / most).cast("int")), lambda i: F.array_join(F.slice(w, i * most + 1, most), " "))
        return F.transform(F.array(self.list(text)), parts)[0]


_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """A vocabulary file of the tokenizers library (.json), read once a worker."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _ENCODERS[path] = t
    return _ENCODERS[path]


def _slices(texts: list[str], most: int = 1 << 16) -> Iterator[list[str]]:
    """The texts in runs of about ``most`` characters: the library's answer is many times the size of what it is asked."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i + 1 == len(texts):
            yield texts[at : i + 1]
            at, size = i + 1, 0


@dataclass(frozen=True)
class Subwords:
    """Tokens are those of a byte-level vocabulary file; texts go to its library in Arrow batches."""

    path: str

    def count(self, text: Column) -> Column:
        path = self.path

        @F.pandas_udf("int")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([n for some in _slices(texts.fillna("").tolist()) for n in map(len, _encoder(path).encode_batch_fast(some, add_special_tokens=False))], dtype="int32")

        return run(text)

    def cut(self, text: Column, most: int) -> Column:
        """The text in parts of at most ``most`` tokens of its encoding, cut at the last character that begins there."""
        path = self.path

        @F.pandas_udf("array<string>")
        def run(texts: pd.Series) -> pd.Series:
            def parts(t: str) -> list[str]:
                spans = _encoder(path).encode(t, add_special_tokens=False).offsets
                at = sorted({0, len(t), *(spans[i][0] for i in range(most, len(spans), most))})
                return [t[p:q] for p, q in zip(at, at[1:])] or [t]

            return pd.Series([parts(t or "") for t in texts])

        return run(text)


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(text, _MARK, " "), SENTENCE, f"$1{_MARK}$2"), _MARK)


def units(rows: DataFrame, key: str, pos: str, text: str, *, most: int, tokens: Words | Subwords = Words()) -> DataFrame:  # noqa: B008
    """key, pos, text, t, i: rows with tokens; one of over ``most`` tokens comes as sentences, a sentence of over ``most`` as parts. ``i`` numbers
    a key's units from 0 in order; rows without tokens are left out."""
    keep = F.col("t") <= most
    # each step is stored, so that no text is read or counted twice and a task keeps one worker with a vocabulary
    base = stored(rows.select(key, pos, F.col(text).alias("text")).withColumn("t", tokens.count(F.coalesce("text", F.lit("")))), "counted").where("t > 0")
    fit = base.where(keep).select(key, pos, F.lit(0).alias("_s"), F.lit(0).alias("_p"), "text", "t")
    said = stored(base.where(~keep).select(key, pos, F.posexplode(sentences(F.col("text"))).alias("_s", "text")).withColumn("t", tokens.count(F.col("text"))), "said").where("t > 0")
    short = said.where(keep).select(key, pos, "_s", F.lit(0).alias("_p"), "text", "t")
    parts = stored(said.where(~keep).select(key, pos, "_s", F.posexplode(tokens.cut(F.col("text"), most)).alias("_p", "text")), "parts")
    cut = parts.withColumn("t", F.least(F.lit(most), tokens.count(F.col("text"))))  # a part alone may split otherwise than in its sentence
    whole = fit.unionByName(short).unionByName(cut)
    return whole.withColumn("i", F.row_number().over(W.partitionBy(key).orderBy(pos, "_s", "_p")) - 1).select(key, pos, "text", "t", "i")


def next_ends(rows: DataFrame, key: str, *, target: int, most: int, overlap: int) -> DataFrame:
    """key, e, begin, end for e = -1 and every unit: the chunk that follows one that ends at unit ``e``.

    It begins with the last whole units of up to ``overlap`` tokens (one at least), unless they leave no room for the unit after e. It
    ends with the unit that brings it over ``target``, or before that one if it would bring it over ``most``, or with the last unit.
    """
    by = W.partitionBy(key).orderBy("i")
    sums = rows.select(key, "i", "t", F.sum("t").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("p"), F.lead("t").over(by).alias("ahead"), F.max("i").over(W.partitionBy(key)).alias("last"))
    near = W.partitionBy(key).orderBy("p").rangeBetween(-overlap, 0)
    # units have tokens, so ``p`` rises strictly: the first unit whose sum is within reach is the one before the overlap
    back = F.when(F.col("p") <= overlap, 0).otherwise(F.least(F.min("i").over(near) + 1, F.col("i")))
    reach = sums.withColumn("back", back)
    held = sums.select(key, F.col("i").alias("back"), (F.col("p") - F.col("t")).alias("base"))  # tokens before a unit
    asked = reach.join(held, [key, "back"]).where(F.col("i") < F.col("last"))
    room = F.col("p") - F.col("base") + F.col("ahead") <= most
    asked = asked.select(key, F.col("i").alias("e"), F.when(room, F.col("back")).otherwise(F.col("i") + 1).alias("begin"), F.when(room, F.col("base")).otherwise(F.col("p")).alias("base"), "last")
    first = rows.groupBy(key).agg(F.max("i").alias("last")).select(key, F.lit(-1).alias("e"), F.lit(0).alias("begin"), F.lit(0).cast("long").alias("base"), "last")
    asked = asked.unionByName(first)
    # the first unit whose sum passes base + target: questions and sums in one order of sums, read from the far end
    points = sums.select(key, F.col("p").alias("v"), F.lit(1).alias("kind"), F.col("i"), "t", "p", *[F.lit(None).cast("int").alias(c) for c in ("e", "begin", "last")], F.lit(None).cast("long").alias("base"))
    questions = asked.select(key, (F.col("base") + target).alias("v"), F.lit(2).alias("kind"), *[F.lit(None).cast(k).alias(c) for c, k in (("i", "int"), ("t", "int"), ("p", "long"))], "e", "begin", "last", "base")
    far = W.partitionBy(key).orderBy(F.desc("v"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    # a sum equal to base + target is no passing one: at equal values questions come first, so they see later sums only
    met = points.unionByName(questions).withColumn("over", F.last(F.when(F.col("kind") == 1, F.struct("i", "p")), ignorenulls=True).over(far)).where("kind = 2")
    over = F.col("over.i")
    fresh = F.col("e") + 1
    end = F.when(over.isNull(), F.col("last")).when((F.col("over.p") - F.col("base") <= most) | (over <= fresh), F.greatest(over, fresh)).otherwise(over - 1)
    return met.select(key, "e", "begin", end.cast("int").alias("end"))


def chunk_ends(following: DataFrame, key: str) -> DataFrame:
    """key, e: the ends that chunks really have, and -1, by pointer doubling over ``following`` (key, e, end)."""
    jump = stored(following.select(key, "e", F.col("end").alias("to")), "jumps")
    reached = jump.where("e = -1").select(key, "e")
    while True:
        reached = stored(reached.unionByName(reached.join(jump, [key, "e"]).select(key, F.col("to").alias("e"))), "ends")
        on = jump.withColumnRenamed("e", "m").withColumnRenamed("to", "far")
        jump = stored(jump.join(on.withColumnRenamed("m", "to"), [key, "to"]).select(key, "e", F.col("far").alias("to")), "jumps")
        if jump.where("e = -1").isEmpty():  # no document has so many chunks
            return reached


def chunks(rows: DataFrame, key: str, pos: str, text: str, *, target: int = 400, most: int = 512, overlap: int = 50, tokens: Words | Subwords = Words()) -> DataFrame:  # noqa: B008
    """key, chunk (from 0), first_pos, last_pos, n_tokens, text: the units of each key in chunks by ``next_ends``, texts joined by newlines.

    Rows without tokens and null texts are left out; keys without tokens have no chunk; null keys are left out; other columns are not looked at.
    ``overlap`` and the longest unit bound what a chunk repeats.
    """
    parts = stored(units(rows.where(F.col(key).isNotNull()), key, pos, text, most=most, tokens=tokens), "units")
    following = stored(next_ends(parts, key, target=target, most=most, overlap=overlap), "following")
    found = chunk_ends(following, key).join(following, [key, "e"])
    found = stored(found.withColumn("chunk", F.row_number().over(W.partitionBy(key).orderBy("e")) - 1), "chunks")
    # a unit is new in one chunk, the first that ends at or behind it, and repeated in others that begin before their news
    new = parts.join(found.select(key, F.col("end").alias("i"), "chunk"), [key, "i"], "left")
    up = W.partitionBy(key).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    new = new.withColumn("chunk", F.last("chunk", ignorenulls=True).over(up)).select(key, "chunk", "i", pos, "text", "t")
    again = found.where("begin <= e").select(key, "chunk", F.explode(F.sequence("begin", "e")).alias("i")).join(parts, [key, "i"]).select(key, "chunk", "i", pos, "text", "t")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])  # at most ``most`` tokens
    return new.unionByName(again).groupBy(key, "chunk").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.sum("t").alias("n_tokens"), F.array_join(listed, "\n").alias("text"))
