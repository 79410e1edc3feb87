"""How a result came about: candidate metadata, what a model changed, who reviews it, and short traces of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.compliance import lookup
from tessera.packs import MATCH_RANK

# Labels of the graded language test.
LANGUAGE_LABELS = ((1.0, "shall / must — mandatory"), (0.75, "will — obligation with slight ambiguity"), (0.5, "should / is required to — recommended"), (0.25, "may — permissive"))


def language_label(strength: Column) -> Column:
    out = F.when(F.lit(False), "")
    for least, label in LANGUAGE_LABELS:
        out = out.when(strength >= least, label)
    return out.otherwise("none detected")


def score_bucket(score: Column) -> Column:
    """high from 0.70, medium from 0.35, else low; null without a score."""
    return F.when(score >= 0.70, "high").when(score >= 0.35, "medium").when(score.isNotNull(), "low")


def candidate(by_pattern: Column, by_similarity: Column, score: Column) -> Column:
    """Struct of both flags, the similarity and its bucket where similarity chose the candidate, and where it came from."""
    found, near = F.coalesce(by_pattern, F.lit(False)), F.coalesce(by_similarity, F.lit(False))
    source = F.when(found & near, "merged").when(found, "deterministic").when(near, "semantic").otherwise("excluded")
    kept = F.when(near, score)
    return F.struct(found.alias("deterministic_candidate"), near.alias("semantic_candidate"), kept.alias("semantic_score"), score_bucket(kept).alias("semantic_score_bucket"), source.alias("candidate_source"))


def match_delta(before: Column, after: Column, attempted: Column) -> Column:
    """What a model made of a match type: no_change, ai_upgrade or ai_downgrade; null where none was asked."""
    a, b = lookup(MATCH_RANK, before, 0), lookup(MATCH_RANK, after, 0)
    return F.when(~attempted, None).when(before == after, "no_change").when(b > a, "ai_upgrade").otherwise("ai_downgrade")


def proposal_delta(source: Column) -> Column:
    return F.when(source == "hybrid", "no_change").when(source == "llm", "ai_override")


def match_review(match_type: Column, bucket: Column, delta: Column) -> Column:
    return F.when(F.coalesce(bucket == "low", F.lit(False)) | F.coalesce(delta.isin("ai_upgrade", "ai_downgrade"), F.lit(False)), "HIGH").when(F.coalesce(bucket == "medium", F.lit(False)) | (match_type == "PARTIAL_MATCH"), "MEDIUM").otherwise("LOW")


def proposal_review(kind: Column, bucket: Column, clause: Column) -> Column:
    """An empty clause, a hard finding type or low confidence asks for a look; null clauses are empty."""
    empty = F.trim(F.coalesce(clause, F.lit(""))) == ""
    return F.when(F.coalesce(bucket == "low", F.lit(False)) | empty | kind.isin("NON_TRANSFERABLE_REGULATION", "OPERATIONAL_RISK"), "HIGH").when(F.coalesce(bucket == "medium", F.lit(False)), "MEDIUM").otherwise("LOW")


def _basis(**facts: Column) -> Column:
    return F.array(*[F.concat(F.lit(f"{n}="), F.coalesce(c.cast("string"), F.lit("None"))) for n, c in facts.items()])


def _trace(kind: str, source: Column, basis: Column, evidence: Column) -> Column:
    whole = F.struct(F.lit(kind).alias("analysis_type"), basis.alias("decision_basis"), evidence.alias("evidence_tokens"))
    return F.when(source != "rule_based", whole)


def obligation_trace(source: Column, assessment: Column, severity: Column, confidence: Column, evidence: Column) -> Column:
    """The first six pieces of evidence; null where rules alone decided."""
    return _trace("obligation_classification", source, _basis(assessment=assessment, severity=severity, confidence=confidence), F.slice(evidence, 1, 6))


def match_trace(source: Column, baseline: Column, final: Column, confidence: Column, evidence: Column) -> Column:
    """The first four pieces of evidence; null where rules alone decided."""
    return _trace("sr_match_validation", source, _basis(baseline=baseline, final=final, confidence=confidence), F.slice(evidence, 1, 4))


def proposal_trace(source: Column, finding_type: Column, confidence: Column) -> Column:
    return _trace("remediation_proposal", source, _basis(finding_type=finding_type, confidence=confidence, source=source), F.array().cast("array<string>"))
