"""Documents to clauses: normalising, block kinds, layout, segmentation, running offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.composition import composed

MAX_HEADING = 200


def normalise(text: Column) -> Column:
    """Characters in canonical composition, quotes, dashes and spaces to ASCII, replacement characters dropped, runs of spaces and blank lines shortened."""
    t = F.translate(composed(text), "‘’“”–— �", "''\"\"-- ")
    t = F.regexp_replace(t, " {2,}", " ")
    t = F.regexp_replace(t, r"[ \t]+(?=\n|$)", "")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_clause(text: Column) -> Column:
    """The text without lines that are page numbers, running headers or other artefacts; runs of blank lines shortened, ends stripped."""
    plain = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    kept = F.filter(F.split(text, "\n"), lambda x: (plain(x) == "") | ~is_artefact(plain(x)))
    return plain(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def is_artefact(line: Column) -> Column:
    return (F.length(line) < 4) | line.rlike(PAGE_ONLY) | line.rlike(SKIP_WORDS)


def aggregate_text(rows: DataFrame, key: str, pos: str, *columns: str) -> DataFrame:
    """key, text: in order of ``pos`` the first filled of ``columns`` of every row, joined by blank lines; rows without any are left out."""
    first = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])
    listed = F.array_sort(F.collect_list(F.when(first.isNotNull(), F.struct(pos, first.alias("text")))))
    return rows.groupBy(key).agg(F.array_join(listed["text"], "\n\n").alias("text"))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *extra: str) -> DataFrame:
    """key, pos (from 0), line."""
    return docs.select(key, *extra, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, page (from 1), pos, text: form feeds end pages, blank lines end paragraphs, empty ones go."""
    pages = docs.select(key, F.posexplode(F.split(text, "\f")).alias("_p", "_page"))
    rows = pages.select(key, (F.col("_p") + 1).alias("page"), F.posexplode(F.split("_page", r"\n{2,}")).alias("_i", "text"))
    rows = rows.withColumn("text", F.trim("text")).where("text <> ''")
    return rows.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy("page", "_i")) - 1).select(key, "page", "pos", "text")


# Patterns of headings, contents, artefacts, bullets.
NUMBERED = r"(?m)^\s*(?:(?:\d{1,2}\.){1,4}\d{0,2}|[IVXLCDM]{1,6}\.)\s{1,4}[A-ZÜÄÖÑ\"]"
TOC_LINE = r"^.{3,}(?:\.{3,}\s*\d{1,3}|\s{3,}\d{1,3}|\t\d{1,3})\s*$"
TOC_TITLE = r"(?i)^(?:table\s+of\s+contents?|contents?|index|inhaltsverzeichnis)\s*$"
PAGE_ONLY = r"^\s*[-–—]?\s*\d{1,3}\s*[-–—]?\s*$"
SKIP_WORDS = r"(?i)^(?:confidential|draft|version|revision|prepared\s+by|date:|document\s+id|page\s+\d|copyright|©|proprietary)[\s:—\-]*"
COLON = r"^[^:\n\r]{5,100}:\s*$"
BULLET = r"^\s*(?:[•·▪▸►‣◦\-–—*]|\d+[.)]\s)\s+\S"


def block_kind(text: Column) -> Column:
    """skip, toc, heading, heading_colon or body: the first test that holds."""
    t = F.trim(text)
    words = F.filter(F.split(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", ""), r"\s+"), lambda w: F.length(w) > 2)
    upper = F.size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w))))
    caps = (~F.contains(t, F.lit("\n"))) & (F.length(t) <= MAX_HEADING) & F.size(words).between(1, 12) & (upper >= 0.7 * F.size(words))
    rows = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    toc = t.rlike(TOC_TITLE) | (F.size(F.filter(rows, lambda x: F.trim(x).rlike(TOC_LINE))) >= 0.5 * F.size(rows))
    return F.when(t.isNull() | is_artefact(t), "skip").when(toc, "toc").when(t.rlike(NUMBERED) & (F.length(t) <= MAX_HEADING), "heading").when(caps, "heading").when(t.rlike(COLON) & ~F.contains(t, F.lit("\n")), "heading_colon").otherwise("body")


def layout(text: Column) -> Column:
    """table, bullet_list or paragraph by the share of lines that look it."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n = F.size(rows)
    share = lambda p: F.size(F.filter(rows, lambda x: x.rlike(p)))
    pipes, tabs, bullets = F.size(F.filter(rows, lambda x: F.contains(x, F.lit("|")))), share("\t|  {3,}"), share(BULLET)
    columns = F.transform(F.slice(rows, 1, 6), lambda x: F.size(F.split(x, "\t|  {3,}")))
    even = (F.size(F.array_distinct(columns)) <= 2) & (F.element_at(columns, 1) >= 2)
    after_colon = F.element_at(rows, 1).rlike(COLON) & (F.size(F.filter(F.slice(rows, 2, 1 << 20), lambda x: x.rlike(BULLET))) >= 0.5 * (n - 1))
    return F.when(text.isNull() | (n == 0), "paragraph").when((pipes >= 2) & (pipes >= 0.35 * n), "table").when((n >= 3) & (tabs >= 0.6 * n) & even, "table").when((bullets >= 2) & (bullets >= 0.3 * n), "bullet_list").when((n >= 2) & after_colon, "bullet_list").otherwise("paragraph")


# Words of obligation, English and German, by their strength.
STRENGTHS = ((1.0, r"shall|muss|müssen|hat\s+zu|haben\s+zu|must"), (0.75, "will"), (0.5, r"should|sollten?|is\s+required\s+to|sind\s+verpflichtet"), (0.25, "may|kann|können|darf|dürfen"))


def language_strength(text: Column, words: tuple[tuple[float, str], ...] = STRENGTHS) -> Column:
    """The strength of the first of ``words`` (strength, alternatives) that stands in the text as a word, .1 where none does."""
    out = F.when(F.lit(False), 0.0)
    for strength, p in words:
        out = out.when(F.coalesce(text.rlike(rf"(?iu)(?:^|[^\p{{L}}\p{{N}}_])(?:{p})(?:[^\p{{L}}\p{{N}}_]|$)"), F.lit(False)), strength)
    return out.otherwise(0.1)


def segments(elements: DataFrame, key: str, pos: str, starts: Column, alone: Column | None = None) -> DataFrame:
    """Adds seg, from 1: a new one begins at every row where ``starts`` holds; a row that is ``alone`` is its own segment."""
    w = W.partitionBy(key).orderBy(pos)
    single = F.lit(False) if alone is None else F.coalesce(alone, F.lit(False))
    marked = elements.withColumn("_s", F.coalesce(starts, F.lit(False)) | single).withColumn("_t", single)
    begin = F.col("_s") | F.coalesce(F.lag("_t").over(w), F.lit(False)) | (F.row_number().over(w) == 1)
    return marked.withColumn("_b", begin.cast("int")).withColumn("seg", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s", "_t", "_b")


def offsets(rows: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Adds begin and end: character offsets of rows that are joined by one separator."""
    w = W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0))
    return rows.withColumn("begin", begin).withColumn("end", F.col("begin") + F.length(text))


def last_heading(rows: DataFrame, key: str, pos: str, heading: Column) -> DataFrame:
    """Adds section: the nearest heading at or above the row."""
    w = W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def pair_orphans(rows: DataFrame, key: str, pos: str, orphan: Column) -> DataFrame:
    """Adds merge_with_next: in every run of orphan headings, with the row after it, rows pair off from the run's beginning."""
    w = W.partitionBy(key).orderBy(pos)
    marked = rows.withColumn("_o", F.coalesce(orphan, F.lit(False)))
    run = F.sum((~F.col("_o")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = marked.withColumn("_run", run).withColumn("_next", F.lead(F.lit(1)).over(w))
    place = F.row_number().over(W.partitionBy(key, "_run", "_o").orderBy(pos))
    return marked.withColumn("merge_with_next", F.col("_o") & (place % 2 == 1) & F.col("_next").isNotNull()).drop("_o", "_run", "_next")


def reflow(rows: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """key, seg, text: lines joined until one ends a sentence."""
    ends = F.lag(F.col(text).rlike(r"[.!?:;]\s*$")).over(W.partitionBy(key).orderBy(pos))
    return segments(rows.withColumn("_e", ends), key, pos, F.col("_e")).groupBy(key, "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]), " ").alias("text"))
