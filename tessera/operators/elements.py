"""Parsed elements with fonts and list marks: heading levels, list groups, internal headings, spatial order, prompt routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.segments import NUMBERED

# Marks of headings and lists.
GERMAN_SECTION = r"^\s*§\s*\d+"
NUMBERED_SECTION = r"(?i)^\s*(?:\d+(?:\.\d+)*\.?\s+\S|(?:section|article|clause|annex|schedule|artikel|abschnitt)\s+\S)"
LETTERED = r"^\s*\(?[a-zA-Z]\)\s+\S"
BULLET_MARK = r"^\s*[•·▪▸►‣◦\-–—*]\s+"
LIST_ITEM = r"^\s*(?:\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S"


def words(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def heading_level(text: Column, font: Column, median: Column) -> Column:
    """1, 2, 3 or null: by the font's size against the median, then section marks; more than 20 words are never a heading."""
    ratio = font / F.nullif(median, F.lit(0.0))
    depth = F.least(F.length(F.regexp_replace(F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)", 1), r"[^.]", "")) + 1, F.lit(3))
    depth = F.when(text.rlike(r"^\s*\d"), depth).otherwise(2)
    return (
        F.when((words(text) == 0) | (words(text) > 20), None)
        .when(ratio >= 1.5, 1)
        .when(ratio >= 1.3, 2)
        .when(ratio >= 1.2, 3)
        .when(text.rlike(GERMAN_SECTION), 2)
        .when(text.rlike(NUMBERED_SECTION), depth)
        .when(text.rlike(LETTERED) & (words(text) <= 10), 3)
    )


def promote_headings(blocks: DataFrame, key: str) -> DataFrame:
    """Adds heading: blocks of at most 3 lines and 200 characters whose font exceeds 1.15 times the document's upper median, and that are
    bold or exceed it 1.2 times. Blocks: key, text, font, bold."""
    middle = blocks.groupBy(key).agg(F.percentile_approx("font", 0.5, F.lit(10_000)).alias("_median"))
    small = (F.size(F.split("text", "\n")) <= 3) & (F.length("text") <= 200)
    big = (F.col("font") > 1.15 * F.col("_median")) & ((F.col("font") > 1.2 * F.col("_median")) | F.col("bold"))
    return blocks.join(middle, key).withColumn("heading", small & big).drop("_median")


def is_preamble(text: Column) -> Column:
    return text.rlike(r":\s*$") & (words(text) <= 40)


def list_groups(rows: DataFrame, key: str, pos: str, item: Column, preamble: Column) -> DataFrame:
    """Adds list_group: items in a row, with the preamble right before them, share a number; other rows have null."""
    w = W.partitionBy(key).orderBy(pos)
    marked = rows.withColumn("_i", F.coalesce(item, F.lit(False))).withColumn("_p", F.coalesce(preamble, F.lit(False)) & ~F.coalesce(item, F.lit(False)))
    opens = F.col("_p") & F.coalesce(F.lead("_i").over(w), F.lit(False))
    member = F.col("_i") | opens
    begins = opens | (F.col("_i") & ~F.coalesce(F.lag("_i").over(w) | F.lag("_p").over(w), F.lit(False)))
    numbered = marked.withColumn("_m", member).withColumn("_b", begins.cast("int"))
    return numbered.withColumn("list_group", F.when(F.col("_m"), F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_i", "_p", "_m", "_b")


def split_internal(rows: DataFrame, key: str, pos: str, text: str, *, least_lines: int = 3) -> DataFrame:
    """key, pos, part, text: texts of ``least_lines`` lines or more are cut before each line that is a numbered heading."""
    lines = rows.select(key, pos, F.posexplode(F.split(text, "\n")).alias("_i", "_line"), F.size(F.split(text, "\n")).alias("_n"))
    starts = (F.col("_n") >= least_lines) & (F.col("_i") > 0) & F.trim("_line").rlike(NUMBERED)
    part = F.sum(starts.cast("int")).over(W.partitionBy(key, pos).orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("part", part).groupBy(key, pos, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_line"))), lambda x: x["_line"]), "\n").alias("text"))


def spatial_order(x: Column, y: Column) -> list[Column]:
    """Rows of about ten units, then left to right."""
    return [F.bround(y / 10), x]


def running_page(words_before: Column, per_page: int = 500) -> Column:
    return F.floor(words_before / per_page) + 1


def prompt_of(layout: Column) -> Column:
    return F.when(layout == "table", "table").when(layout.isin("bullet_list", "list"), "list").when(layout == "ocr_text", "ocr").otherwise("paragraph")
