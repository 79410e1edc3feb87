"""From findings to reports: the joined trace, the negotiation brief, the package and the risk report, one frame for each grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.compliance import lookup, rank

# Topics in the order of the report.
TOPIC_ORDER = {"REGULATORY_COMPLIANCE": 0, "DATA_PROTECTION": 1, "SECURITY_CONTROLS": 2, "INCIDENT_MANAGEMENT": 3, "AUDIT_RIGHTS": 4, "SERVICE_LEVELS": 5, "OTHER": 6}


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def last_by(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row a key: the last by position, as when an index is filled in order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(position)).alias("_r")).select("_r.*")


def trace(clauses: DataFrame, obligations: DataFrame, matches: DataFrame, proposals: DataFrame, topics: DataFrame, *, key: str = "clause_id") -> DataFrame:
    """A record for every clause with its assessment, its matches (best first), its proposal and its topic.

    obligations, proposals, topics carry key and position; the last of a key counts. NO_MATCH rows are left out.
    """
    real = matches.where("match_type <> 'NO_MATCH'")
    listed = real.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("match_confidence")).alias("order"), "sr_id", "match_type", "match_confidence"))).alias("sr_matches"))
    out = clauses
    for side in (obligations, proposals, topics):
        out = out.join(last_by(side, key, "position").drop("position"), key, "left")
    return out.join(listed, key, "left").withColumn("n_matches", F.greatest(F.size("sr_matches"), F.lit(0)))


def with_details(findings: DataFrame, details: DataFrame, key: str, *columns: str, severities: tuple[str, ...] = ("HIGH", "MEDIUM")) -> DataFrame:
    """Findings of these severities; where one lacks a value of ``columns``, the last detail (by position) of its key gives it."""
    last = last_by(details.select(key, "position", *columns), key, "position").select(key, *[F.col(c).alias(f"_d_{c}") for c in columns])
    kept = findings.where(F.col("severity").isin(*severities)).join(last, key, "left")
    own = [c for c in findings.columns if c not in columns]
    return kept.select(*own, *[(F.coalesce(F.col(c), F.col(f"_d_{c}")) if c in findings.columns else F.col(f"_d_{c}")).alias(c) for c in columns])


def proposal_findings(proposals: DataFrame, reasons: DataFrame, matches: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Proposals as findings: the reason of the key's obligation or else the proposal's preview, its matches (best first) and its whole text."""
    listed = matches.where("match_type <> 'NO_MATCH'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("match_confidence")).alias("order"), "sr_id"))).alias("_m"))
    why = last_by(reasons.select(key, "position", "reason"), key, "position").select(key, "reason")
    out = proposals.join(why, key, "left").join(listed, key, "left").join(texts.select(key, "clause_full_text"), key, "left")
    empty = F.array().cast("array<string>")
    return out.withColumn("reason", first_filled(F.col("reason"), F.col("preview"))).withColumn("sr_matches", F.coalesce(F.col("_m.sr_id").cast("array<string>"), empty)).withColumn("clause_full_text", F.coalesce("clause_full_text", F.lit(""))).drop("_m")


def brief(findings: DataFrame, *keys: str) -> DataFrame:
    """A section for each topic: issues, highest severity, number of affected clauses, types in order, place in the report. The clauses
    themselves are ``affected``."""
    each = findings.groupBy(*keys, "topic", "clause_id", "finding_type").agg(
        F.count("*").alias("_n"),
        F.max(rank(F.col("severity"))).alias("_r"),
        F.count_if(F.col("severity") == "HIGH").alias("_high"),
        F.count_if(F.col("severity") == "MEDIUM").alias("_medium"),
    )
    out = each.groupBy(*keys, "topic").agg(
        F.sum("_n").alias("issue_count"),
        F.max("_r").alias("_r"),
        F.countDistinct("clause_id").alias("n_affected"),
        F.array_sort(F.collect_set("finding_type")).alias("finding_types"),  # of a fixed set
        F.sum("_high").alias("n_high"),
        F.sum("_medium").alias("n_medium"),
    )
    out = out.withColumn("highest_severity", F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.greatest(F.col("_r"), F.lit(0)) + 1))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_r"), lookup(TOPIC_ORDER, F.col("topic"), 9), "topic"))
    return out.withColumn("section", place).drop("_r")


def affected(findings: DataFrame, *keys: str) -> DataFrame:
    """keys, topic, clause_id: the clauses of each section, a row each."""
    return findings.select(*keys, "topic", "clause_id").distinct()


def primary_proposal(proposals: DataFrame, key: str) -> DataFrame:
    """key, proposal: of the most severe proposals the first."""
    return proposals.groupBy(key).agg(F.min_by("proposal", F.struct(-rank(F.col("severity")), F.col("position"))).alias("proposal"))


def package(actions: DataFrame, members: DataFrame, matches: DataFrame, *keys: str, group: str = "finding_type", item: str = "clause_id") -> DataFrame:
    """A negotiation item for every action: its requirements (first four), frameworks and numbered id. actions: keys, ``group``, action_no, priority,
    n_clauses; members: keys, ``group``, ``item``; matches: keys, ``item``, sr_id, framework, match_type."""
    cited = members.select(*keys, group, item).join(matches.where("match_type <> 'NO_MATCH'"), [*keys, item]).select(*keys, group, "sr_id", "framework").distinct()
    refs = cited.groupBy(*keys, group).agg(F.array_sort(F.collect_set("sr_id")).alias("_srs"), F.array_sort(F.collect_set("framework")).alias("frameworks"))  # of the catalogue
    out = actions.join(refs, [*keys, group], "left")
    empty = F.array().cast("array<string>")
    return out.select(*keys, F.col(group), F.format_string("NEG-%03d", "action_no").alias("item_id"), "priority", F.slice(F.coalesce("_srs", empty), 1, 4).alias("evidence"), F.coalesce("frameworks", empty).alias("frameworks"), "n_clauses")


def risk_distribution(scores: DataFrame, *keys: str) -> DataFrame:
    n = lambda p: F.count_if(F.col("priority") == p)
    valid = F.count_if(F.coalesce("assessment", F.lit("VALID")) == "VALID")
    return scores.groupBy(*keys).agg(F.count("*").alias("total"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"), valid.alias("valid")).withColumn("low_risk", F.col("low") - F.col("valid"))
