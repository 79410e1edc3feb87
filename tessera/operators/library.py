"""The requirement library's side: match confidence, best match, penalties, promoted findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Scores of the quality bands.
BAND = {"STRONG": 1.00, "ADEQUATE": 0.75, "WEAK": 0.50, "INADEQUATE": 0.25, "NOMINAL": 0.10}


def match_confidence(similarity: Column, model: Column, band: Column) -> Column:
    """0.35 similarity + 0.45 model + 0.20 band, in 0..1, four digits; an unknown band counts 0.5."""
    b = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BAND.items() for x in kv]), F.upper(band)), F.lit(0.5))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * similarity + 0.45 * model + 0.20 * b)), 4)


def best_match(matches: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Adds is_best: the first row of each key in ``order``."""
    return matches.withColumn("is_best", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1)


def penalty(rows: DataFrame, key: str, factor: str) -> DataFrame:
    """key, factor: the product of all factors, zeros included."""
    return rows.groupBy(key).agg(F.product(F.col(factor)).alias("factor"))


def quality(post: Column, raw: Column) -> Column:
    """A zero counts as missing."""
    return F.coalesce(F.nullif(post, F.lit(0.0)), F.nullif(raw, F.lit(0.0)), F.lit(0.0))


def risk_severity(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 35, "medium").otherwise("low")


def modifiers(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """key and, for each column, its distinct values in order, nulls left out."""
    return rows.groupBy(key).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])


def promote(matches: DataFrame, penalties: DataFrame, findings: DataFrame, keys: list[str], *order: Column, clause: str = "clause_id") -> DataFrame:
    """Findings to insert: of each key the best match (covering in full or part, highest match_confidence, nulls last, then similarity, then ``order``), unless
    ``findings`` (``keys``, finding_type) holds one that is not ``missing``. Run again with its result among ``findings`` it gives none.

    matches: ``keys``, ``clause``, coverage, match_confidence, model_confidence, similarity, raw_quality, missing_elements (array). penalties: ``clause``, factor, one row
    for each penalty. The quality behind the risk is the raw one times all penalties.
    """
    held = findings.where("finding_type <> 'missing'").select(*keys).distinct()
    rows = best_match(matches.where(F.col("coverage").isin("full", "partial")), keys, F.desc_nulls_last("match_confidence"), F.desc("similarity"), *order).where("is_best")
    rows = rows.join(held, keys, "left_anti").join(penalty(penalties, clause, "factor"), clause, "left")
    post = F.col("raw_quality") * F.coalesce("factor", F.lit(1.0))
    risk = F.round(100 * (1 - quality(post, F.col("raw_quality"))), 2)
    lacking = F.array_join(F.coalesce("missing_elements", F.array().cast("array<string>")), "; ")
    advice = F.when(F.col("coverage") == "full", "No action required.").when(lacking != "", F.concat(F.lit("Add: "), lacking)).otherwise("Clarify the clause.")
    out = rows.withColumn("post_modifier_quality", post).withColumn("clause_risk_score", risk)
    return out.select(
        *keys,
        clause,
        F.when(F.col("coverage") == "full", "present").otherwise("partial").alias("finding_type"),
        risk_severity(F.col("clause_risk_score")).alias("severity"),
        F.coalesce(F.nullif("match_confidence", F.lit(0.0)), F.nullif("model_confidence", F.lit(0.0)), F.lit(0.5)).alias("confidence"),
        advice.alias("recommendation"),
        "clause_risk_score",
        "post_modifier_quality",
    )
