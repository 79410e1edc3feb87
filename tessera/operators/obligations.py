"""Obligation assessment: ordered rule groups over clause text, the first group that matches wins.

The pack becomes one CASE expression of literal patterns: a single scan without a join, evaluated lazily from the left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.packs import OBLIGATIONS, ObligationPack


def _case(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for test, value in branches:
        out = F.when(test, value) if out is None else out.when(test, value)
    return otherwise if out is None else out.otherwise(otherwise)


def assess(clauses: DataFrame, *, text: str = "text", pack: ObligationPack = OBLIGATIONS) -> DataFrame:
    """Adds assessment, severity, rule (position of the pattern in the pack, null for VALID) and confidence.

    A null text is VALID.
    """
    hit = lambda p: F.coalesce(F.col(text).rlike(pack.flags + p), F.lit(False))
    severe = F.when(hit(pack.escalate), "HIGH").otherwise("MEDIUM")
    branches, n = [], 0
    for group in pack.groups:
        for p in group.patterns:
            branches.append((hit(p), F.struct(F.lit(group.assessment).alias("assessment"), (F.lit(group.severity) if group.severity else severe).alias("severity"), F.lit(n).alias("rule"), F.lit(0.70).alias("confidence"))))
            n += 1
    valid = F.struct(F.lit("VALID").alias("assessment"), F.lit("LOW").alias("severity"), F.lit(None).cast("int").alias("rule"), F.lit(0.75).alias("confidence"))
    return clauses.withColumn("_got", _case(branches, valid)).select("*", "_got.*").drop("_got")


def histogram(assessed: DataFrame, *keys: str) -> DataFrame:
    """Clauses by assessment, with how many are flagged (not VALID) and of high severity."""
    return assessed.groupBy(*keys, "assessment").agg(F.count("*").alias("n_clauses"), F.count_if(F.col("assessment") != "VALID").alias("n_flagged"), F.count_if(F.col("severity") == "HIGH").alias("n_high"))


def merge_model(rules: DataFrame, model: DataFrame, keys: list[str], columns: list[str], *, accept: float = 0.75, hybrid: bool = False) -> DataFrame:
    """Rule results joined with model results (``columns`` + model_confidence) on ``keys``; a model result counts from ``accept`` on.

    ``source``: rule_based without a model result, llm where it counts, else hybrid (or rule_based).
    """
    m = model.select(*keys, *[F.col(c).alias(f"_m_{c}") for c in columns], "model_confidence")
    joined = rules.join(m, keys, "left")
    use = F.coalesce(F.col("model_confidence") >= accept, F.lit(False))
    out = joined.withColumns({c: F.when(use, F.col(f"_m_{c}")).otherwise(F.col(c)) for c in columns})
    source = F.when(use, "llm").when(F.col("model_confidence").isNotNull() & F.lit(hybrid), "hybrid").otherwise("rule_based")
    return out.withColumn("source", source).drop(*[f"_m_{c}" for c in columns])


def confidence_bucket(c: Column) -> Column:
    return F.when(c >= 0.85, "high").when(c >= 0.60, "medium").when(c.isNotNull(), "low")


def severity_delta(rank: dict[str, int], before: Column, after: Column, same_kind: Column, attempted: Column) -> Column:
    """no_change, ai_upgrade, ai_downgrade or ai_override by ordinal; null where no model was asked."""
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    a, b = (F.coalesce(F.element_at(order, x), F.lit(0)) for x in (before, after))
    return F.when(~attempted, None).when(same_kind & (before == after), "no_change").when(b > a, "ai_upgrade").when(b < a, "ai_downgrade").otherwise("ai_override")


def review_priority(assessment: Column, severity: Column, bucket: Column) -> Column:
    hard, soft = ("NON_TRANSFERABLE_REGULATION", "OPERATIONAL_RISK"), ("AMBIGUOUS_REQUIREMENT", "SCOPE_UNDEFINED")
    low = F.coalesce(bucket == "low", F.lit(False)) | (severity == "HIGH") | assessment.isin(*hard)
    medium = F.coalesce(bucket == "medium", F.lit(False)) | assessment.isin(*soft)
    return F.when(low, "HIGH").when(medium, "MEDIUM").otherwise("LOW")
