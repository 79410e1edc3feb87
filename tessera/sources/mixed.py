"""One folder of contracts of several kinds as one table of blocks: text, Word and JSON files, and a row that says why for each file that cannot be read.

Spark's own binary source lists and splits the files by bytes, on any store that it can open. Text and JSON are read by built-in
functions; only Word files go through Python, and a broken one costs its own row, not the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import segments
from tessera.sources.docx import docx_blocks
from tessera.sources.files import raw_files

READ = ("txt", "docx", "json")
_ITEM = "clause_id: string, chunk_id: string, page: int, text: string"


def routed(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Adds suffix and refused, the reason against a file: its size, a suffix that nothing here reads, or content of another kind than the suffix says.
    null where it may be read."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    fits = F.col("accepted") if max_bytes is None else F.col("n_bytes") <= max_bytes
    refused = (
        F.when(~fits, "too large")
        .when(F.col("suffix") == "", "no suffix")
        .when(~F.col("suffix").isin(*READ), F.concat(F.lit("no reader for ."), F.col("suffix")))
        .when((F.col("suffix") == "docx") & (F.col("kind") != "docx"), "not a Word file")
        .when((F.col("suffix") != "docx") & (F.col("kind") != "txt"), F.concat(F.col("kind"), F.lit(" content under ."), F.col("suffix")))
    )
    return files.withColumn("suffix", suffix).withColumn("refused", refused)


def _text(content: Column) -> Column:
    """UTF-8, or Latin-1 where that fails."""
    return F.when(F.expr("is_valid_utf8(cast(content as string))"), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def mixed_blocks(spark: SparkSession, path: str, *, envelope: str = "clauses", max_bytes: int | None = None) -> DataFrame:
    """path, pos (from 0), page, kind, text, error: the blocks of every file under ``path``.

    Text files give paragraphs, form feeds are pages; Word files their blocks; JSON files the items of a list, or of the list under ``envelope``, by
    their text. kind of text and JSON blocks is that of ``segments.block_kind``. A file that is refused or broken gives one row with kind
    ``error`` and the reason; one without any block gives none.
    """
    files = routed(raw_files(spark, path), max_bytes)
    good = files.where("refused is null")
    empty = F.lit(None).cast("string")
    refused = files.where("refused is not null").select("path", F.lit(0).alias("pos"), F.lit(0).alias("page"), F.lit("error").alias("kind"), empty.alias("text"), F.col("refused").alias("error"))
    plain = segments.paragraphs(good.where("suffix = 'txt'").select("path", _text(F.col("content")).alias("text")), "path", "text")
    plain = plain.select("path", F.col("pos").cast("int"), F.col("page").cast("int"), segments.block_kind(F.col("text")).alias("kind"), "text", empty.alias("error"))
    listed = good.where("suffix = 'json'").select("path", _text(F.col("content")).alias("value"))
    inside = F.from_json("value", f"struct<`{envelope}`: array<struct<{_ITEM}>>>")[envelope]
    items = listed.withColumn("items", F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_ITEM}>>")).otherwise(inside))
    bad = F.when(F.try_parse_json("value").isNull(), "not JSON").when(F.col("items").isNull(), "no list of items")
    items = items.withColumn("bad", bad)
    broken = items.where("bad is not null").select("path", F.lit(0).alias("pos"), F.lit(0).alias("page"), F.lit("error").alias("kind"), empty.alias("text"), F.col("bad").alias("error"))
    read = items.where("bad is null").select("path", F.posexplode("items").alias("pos", "x")).where("x.text is not null")
    read = read.select("path", "pos", F.coalesce("x.page", F.lit(1)).alias("page"), segments.block_kind(F.col("x.text")).alias("kind"), F.col("x.text").alias("text"), empty.alias("error"))
    word = docx_blocks(good.withColumn("kind", F.col("suffix")))
    word = word.select("path", "pos", "page", "kind", F.when(F.col("kind") != "error", F.col("text")).alias("text"), F.when(F.col("kind") == "error", F.col("text")).alias("error"))
    return plain.unionByName(read).unionByName(broken).unionByName(refused).unionByName(word)
