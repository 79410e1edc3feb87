"""What review screens read: explorers, panels, reasons, run metrics, chunk facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.compliance import BLOCKING, rank


def panels(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """panel, value, n: counts of every panel's values in one pass; an array counts each of its values once a row, an empty or null one as ``OTHER``."""
    kinds = {n: rows.select(c.alias("x")).schema["x"].dataType.typeName() for n, c in named.items()}

    def values(name: str, c: Column) -> Column:
        listed = F.array_distinct(c.cast("array<string>")) if kinds[name] == "array" else F.array(c.cast("string"))
        listed = F.array_compact(F.coalesce(listed, F.array().cast("array<string>")))
        filled = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("OTHER")))
        return F.transform(filled, lambda v: F.struct(F.lit(name).alias("panel"), v.alias("value")))

    each = rows.select(F.explode(F.concat(*[values(n, c) for n, c in named.items()])).alias("p"))
    return each.groupBy("p.panel", "p.value").agg(F.count("*").alias("n"))


def blocking_reasons(findings: DataFrame, *keys: str, finding: str = "finding_key", limit: int = 20) -> DataFrame:
    """keys, place, ``finding``, severity, status: the first ``limit`` unresolved HIGH and MEDIUM findings of each version, HIGH ones first, then by
    ``finding``. A null status is open. The limit is the feature."""
    status, sev = F.coalesce("status", F.lit("open")), F.upper("severity")
    rows = findings.where(sev.isin("HIGH", "MEDIUM") & status.isin(*BLOCKING)).select(*keys, finding, sev.alias("severity"), status.alias("status"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(rank(F.col("severity"))), finding))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def run_metrics(details: DataFrame, *keys: str) -> DataFrame:
    """Counts of a matching run by keys: matches of each kind, promoted ones (DIRECT by the model, not by patterns), refused ones (patterns hit, the
    model says no) and the mean confidence of matches. details: keys, match_type, pattern_type, match_confidence."""
    hit = F.col("match_type") != "NO_MATCH"
    return details.groupBy(*keys).agg(
        *[F.count_if(F.col("match_type") == t).alias(n) for t, n in (("DIRECT_MATCH", "n_direct"), ("PARTIAL_MATCH", "n_partial"), ("NO_MATCH", "n_none"))],
        F.count_if(promoted()).alias("n_promoted"),
        F.count_if(refused()).alias("n_refused"),
        F.round(F.avg(F.when(hit, F.col("match_confidence"))), 4).alias("avg_confidence"),
    )


def promoted() -> Column:
    """A direct match that patterns alone did not give."""
    return (F.col("match_type") == "DIRECT_MATCH") & (F.col("pattern_type") != "DIRECT_MATCH")


def refused() -> Column:
    """A pattern's match that the whole run refuses: a false positive of the patterns."""
    return (F.col("match_type") == "NO_MATCH") & (F.col("pattern_type") != "NO_MATCH")


def explorer(clauses: DataFrame, details: dict[str, tuple[DataFrame, Column]], findings: DataFrame, key: str) -> DataFrame:
    """``clauses`` with the last row of each of ``details`` (name: rows and their order) as struct columns, and n_findings: left joins, each
    clause once whatever the details repeat."""
    out = clauses
    for name, (rows, order) in details.items():
        fields = F.struct(*[c for c in rows.columns if c != key])
        out = out.join(rows.groupBy(key).agg(F.max_by(fields, order).alias(name)), key, "left")
    counted = findings.groupBy(key).agg(F.count("*").alias("n_findings"))
    return out.join(counted, key, "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))


def chunk_facts(elements: DataFrame, *keys: str, override: str = "ocr_text") -> DataFrame:
    """keys, layout, confidence, median_font, main_font of each chunk. elements: keys, pos, text, layout, font, ocr_confidence.

    layout: ``override`` if any element has it, else the most frequent one, of equally frequent ones the first seen. confidence: the mean
    of those known. main_font: the size that most characters have, of several the smallest. Sizes and layouts are few, and are counted
    before they are compared.
    """
    shown = elements.groupBy(*keys, "layout").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    layout = shown.groupBy(*keys).agg(F.when(F.bool_or(F.col("layout") == override), override).otherwise(F.max_by("layout", F.struct("n", -F.col("first")))).alias("layout"))
    sized = elements.groupBy(*keys, "font").agg(F.sum(F.length("text")).alias("n"))
    main = sized.where("font is not null").groupBy(*keys).agg(F.max_by("font", F.struct("n", -F.col("font"))).alias("main_font"))
    rest = elements.groupBy(*keys).agg(F.round(F.avg("ocr_confidence"), 4).alias("confidence"), F.median("font").alias("median_font"))
    return layout.join(main, list(keys), "left").join(rest, list(keys))


def preview(text: Column, most: int, *, always: bool = False, mark: str = "…") -> Column:
    """The first ``most`` characters and ``mark`` where something is cut off, or ``always``; newlines as spaces, ends stripped."""
    plain = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    cut = F.concat(F.substring(plain, 1, most), F.lit(mark))
    return cut if always else F.when(F.length(plain) > most, cut).otherwise(plain)


def side_by_side(findings: DataFrame, before: Column, after: Column, *keys: str) -> DataFrame:
    """keys and for either version (rows where ``before`` or ``after`` holds) findings, HIGH ones and mean score, with their differences."""

    def part(held: Column, end: str) -> list[Column]:
        return [F.count_if(held).alias(f"n_{end}"), F.count_if(held & (F.col("severity") == "HIGH")).alias(f"high_{end}"), F.round(F.avg(F.when(held, F.col("score"))), 6).alias(f"score_{end}")]

    out = findings.groupBy(*keys).agg(*part(before, "before"), *part(after, "after"))
    return out.withColumns({f"{c}_change": F.col(f"{c}_after") - F.col(f"{c}_before") for c in ("n", "high")})


def by_priority(findings: DataFrame, severity: str, keys: list[str], *order: Column) -> DataFrame:
    """Findings of one severity with n_open, how many of the key's are open, and step, their place in ``order``."""
    rows = findings.where(F.col("severity") == severity)
    return rows.withColumn("n_open", F.count_if(F.col("status") == "open").over(W.partitionBy(*keys))).withColumn("step", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
