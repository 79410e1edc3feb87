"""Roll-ups of clause matches: compliance by requirement and framework, overall status, contract decision, clause risk."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.shared import ordered_distinct

from tessera.operators.matching import match_confidence, match_type, pattern_hits
from tessera.packs import MATCH_BONUS_CAP, MATCH_WEIGHT, SEVERITY_BASE, SEVERITY_RANK, TOPIC_BONUS, Requirement


def lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def rank(severity: Column) -> Column:
    return lookup(SEVERITY_RANK, severity, -1)


def compliance(matches: DataFrame, *keys: str, clause: str = "clause_id") -> DataFrame:
    """A row for each requirement: counts by match type, the best clause (first of the most confident) and the result."""
    hit = F.col("match_type") != "NO_MATCH"
    best = F.min_by(F.col(clause), F.struct(-F.col("match_confidence"), F.col(clause))).alias("best_clause")
    out = matches.groupBy(*keys, "framework", "sr_id").agg(
        F.count_if(F.col("match_type") == "DIRECT_MATCH").alias("n_direct"),
        F.count_if(F.col("match_type") == "PARTIAL_MATCH").alias("n_partial"),
        F.max("match_confidence").alias("confidence"),
        best,
        F.count_if(hit).alias("_hits"),
    )
    result = F.when(F.col("n_direct") > 0, "COMPLIANT").when(F.col("n_partial") > 0, "WEAK_MATCH").otherwise("MISSING")
    out = out.withColumn("result", result).withColumn("severity", F.when(result == "MISSING", "HIGH").when(result == "WEAK_MATCH", "MEDIUM").otherwise("LOW"))
    return out.withColumn("best_clause", F.when(F.col("_hits") > 0, F.col("best_clause"))).drop("_hits")


def coverage(results: DataFrame, *keys: str) -> DataFrame:
    """Totals by framework; covered is compliant or weak, in percent to one digit."""
    n = lambda r: F.count_if(F.col("result") == r)
    out = results.groupBy(*keys, "framework").agg(F.count("*").alias("total"), n("COMPLIANT").alias("compliant"), n("WEAK_MATCH").alias("weak"), n("MISSING").alias("missing"))
    return out.withColumn("coverage_percent", F.round((F.col("compliant") + F.col("weak")) / F.col("total") * 100, 1))


def overall(findings: DataFrame, *keys: str) -> DataFrame:
    """Worst severity of all findings and fixed buckets of counts; HIGH blocks."""
    top = F.max(rank(F.col("severity")))
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("HIGH", "MEDIUM", "LOW")]
    status = F.when(top == 2, "HIGH_RISK").when(top == 1, "MEDIUM_RISK").when(top == 0, "LOW_RISK").otherwise("COMPLIANT")
    return (findings.groupBy(*keys) if keys else findings.groupBy()).agg(status.alias("status"), *counts, F.count("*").alias("n_findings"))


def decision(findings: DataFrame, *keys: str) -> DataFrame:
    """REJECT if any finding rejects, else CONDITIONAL_APPROVAL if any is conditional, else APPROVE."""
    kind = finding_class(F.col("severity"), F.col("finding_type"))
    rejects, conditional = F.coalesce(F.bool_or(kind == "REJECT"), F.lit(False)), F.coalesce(F.bool_or(kind == "CONDITIONAL"), F.lit(False))
    return findings.groupBy(*keys).agg(F.when(rejects, "REJECT").when(conditional, "CONDITIONAL_APPROVAL").otherwise("APPROVE").alias("decision"), F.count_if(kind != "APPROVE").alias("n_blocking"), F.count("*").alias("n_findings"))


def finding_class(severity: Column, finding_type: Column) -> Column:
    """A missing requirement of high severity rejects; a weak match of high severity, or medium severity, is conditional."""
    return F.when((severity == "HIGH") & (finding_type == "MISSING"), "REJECT").when(((severity == "HIGH") & (finding_type == "WEAK_MATCH")) | (severity == "MEDIUM"), "CONDITIONAL").otherwise("APPROVE")


# Who owns a finding, by framework and type.
OWNERS = {"DORA MISSING": "Legal", "DORA WEAK_MATCH": "Security", "NIS2 MISSING": "Security", "NIS2 WEAK_MATCH": "Security", "GDPR MISSING": "DPO", "GDPR WEAK_MATCH": "DPO", "ISO27001 MISSING": "Security", "ISO27001 WEAK_MATCH": "Security"}


def owner(framework: Column, finding_type: Column, owners: dict[str, str] = OWNERS, default: str = "Legal") -> Column:
    return lookup(owners, F.concat_ws(" ", framework, finding_type), default)


def clause_scores(clauses: DataFrame, matches: DataFrame, *, key: str = "clause_id", compat_null_assessment: bool = False) -> DataFrame:
    """Risk score 1..10 of clauses(key, assessment, severity, topic) with their matches(key, match_type, match_confidence).

    A null assessment counts as VALID unless ``compat_null_assessment``, which lets the no-match floor hit it.
    """
    real = matches.where(F.col("match_type") != "NO_MATCH")
    per = real.groupBy(key).agg(F.least(F.sum(lookup(MATCH_WEIGHT, F.col("match_type"), 0.0)), F.lit(MATCH_BONUS_CAP)).alias("_bonus"), F.max("match_confidence").alias("_best"))
    return _scored(clauses.join(per, key, "left"), compat_null_assessment)


def clause_scores_of(clauses: DataFrame, catalogue: tuple[Requirement, ...], *, text: str = "text", flags: str = "(?iu)", compat_null_assessment: bool = False) -> DataFrame:
    """The same of clauses(assessment, severity, topic, ``text``) by the catalogue's patterns: one projection, neither a row for each match nor a join."""
    n = len(catalogue)
    hits = [F.col(f"_hits{i}") for i in range(n)]
    rows = clauses.select("*", *[pattern_hits(F.col(text), r, flags).alias(f"_hits{i}") for i, r in enumerate(catalogue)])
    bonus = reduce(add, [lookup(MATCH_WEIGHT, match_type(h), 0.0) for h in hits], F.lit(0.0))
    best = F.greatest(F.lit(0.0), F.lit(0.0), *[match_confidence(h, F.lit(len(r.patterns))) for h, r in zip(hits, catalogue)])
    some = reduce(add, hits, F.lit(0)) > 0
    rows = rows.withColumn("_bonus", F.least(bonus, F.lit(MATCH_BONUS_CAP))).withColumn("_best", F.when(some, best))
    return _scored(rows.drop(*[f"_hits{i}" for i in range(n)]), compat_null_assessment)


def _scored(rows: DataFrame, compat_null_assessment: bool) -> DataFrame:
    base, topic = lookup(SEVERITY_BASE, F.col("severity"), 2.0), lookup(TOPIC_BONUS, F.coalesce("topic", F.lit("OTHER")), 0.0)
    kind = F.col("assessment") if compat_null_assessment else F.coalesce("assessment", F.lit("VALID"))
    raw = F.when(kind.eqNullSafe("AMBIGUOUS_REQUIREMENT"), F.greatest(base + topic, F.coalesce("_best", F.lit(0.0)) * 10)).otherwise(base + topic + F.coalesce("_bonus", F.lit(0.0)))
    raw = F.when(F.col("severity").eqNullSafe("HIGH"), F.greatest(raw, F.lit(7.0))).otherwise(raw)
    raw = F.when(F.col("_best").isNull() & ~kind.eqNullSafe("VALID"), F.greatest(raw, F.lit(6.0))).otherwise(raw)
    return rows.withColumn("risk_score", F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), raw)), 2)).withColumn("priority", priority(F.col("risk_score"))).drop("_bonus", "_best")


def priority(score: Column) -> Column:
    return F.when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")


def topic_summary(scores: DataFrame, *keys: str) -> DataFrame:
    out = scores.groupBy(*keys, F.coalesce("topic", F.lit("VALID")).alias("topic")).agg(F.count("*").alias("n_clauses"), F.max("risk_score").alias("max_score"), F.round(F.avg("risk_score"), 4).alias("avg_score"), F.round(F.sum("risk_score"), 2).alias("total_score"))
    return out.withColumn("priority", priority(F.col("max_score")))


# Fixed values in the two functions below: words that tell topics, in the order in which they are tried.
def topic_of(kind: Column, text: Column, sr_topic: Column) -> Column:
    """Topic of an obligation finding by its type and, where that is open, by words of its text or the topic of its match."""
    has = lambda *w: F.coalesce(F.lower(text).rlike("|".join(w)), F.lit(False))
    return (
        F.when(kind == "NON_TRANSFERABLE_REGULATION", "REGULATORY_COMPLIANCE")
        .when(kind == "CUSTOMER_RESPONSIBILITY", "DATA_PROTECTION")
        .when((kind == "SCOPE_UNDEFINED") & has("law", "regulation", "directive", "statutory", "supervisory"), "REGULATORY_COMPLIANCE")
        .when(kind == "SCOPE_UNDEFINED", "SECURITY_CONTROLS")
        .when((kind == "OPERATIONAL_RISK") & has("audit", "source code", "unrestricted access", "access to all", "unlimited"), "AUDIT_RIGHTS")
        .when((kind == "OPERATIONAL_RISK") & has("sla", "uptime", "availability", "service credit"), "SERVICE_LEVELS")
        .when(kind == "OPERATIONAL_RISK", "INCIDENT_MANAGEMENT")
        .when(kind == "AMBIGUOUS_REQUIREMENT", F.coalesce(sr_topic, F.lit("SECURITY_CONTROLS")))
        .otherwise("OTHER")
    )


def requirement_topic(title: Column, framework: Column) -> Column:
    t = F.lower(title)
    has = lambda *w: t.rlike("|".join(w))
    return F.when(has("incident", "reporting timeline", "notification"), "INCIDENT_MANAGEMENT").when(has("transfer", "subprocessor", "data subject", "dpa", "processing agreement"), "DATA_PROTECTION").when(has("audit"), "AUDIT_RIGHTS").when(has("supply chain"), "SECURITY_CONTROLS").when(framework == "DORA", "REGULATORY_COMPLIANCE").when(framework == "GDPR", "DATA_PROTECTION")


def action_members(findings: DataFrame, *keys: str, item: str = "clause_id", group: str = "finding_type") -> DataFrame:
    """A row for each clause of an action: keys, ``group``, ``item``, its first position, findings, best priority, highest and summed score.

    findings: keys, ``group``, ``item``, position, priority, risk_score.
    """
    return findings.groupBy(*keys, group, item).agg(
        F.min("position").alias("position"),
        F.count("*").alias("n_findings"),
        F.min(lookup({"HIGH": 0, "MEDIUM": 1, "LOW": 2}, F.col("priority"), 3)).alias("_p"),
        F.max("risk_score").alias("max_score"),
        F.sum("risk_score").alias("total_score"),
    )


def action_plan(findings: DataFrame, *keys: str, item: str = "clause_id", group: str = "finding_type") -> DataFrame:
    """An action for each finding type: best priority, highest and summed score, number and first of its clauses, topics in the order of their
    first findings; numbered by priority, highest score, type. Its clauses are the rows of ``action_members``, which no row lists."""
    members = action_members(findings, *keys, item=item, group=group)
    out = members.groupBy(*keys, group).agg(
        F.min("_p").alias("_p"),
        F.round(F.max("max_score"), 2).alias("max_score"),
        F.round(F.sum("total_score"), 2).alias("total_score"),
        F.sum("n_findings").alias("n_findings"),
        F.count("*").alias("n_clauses"),
        F.min_by(item, F.struct("position", item)).alias("first_clause"),
    )
    topics = ordered_distinct(findings, [*keys, group], F.col("topic"), F.col("position"), "topics")  # of a fixed set
    number = F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("_p", F.desc("max_score"), group))  # a row for each type
    named = out.withColumn("priority", F.element_at(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW", "NONE"))), F.col("_p") + 1)).withColumn("action_no", number).drop("_p")
    return named.join(topics, [*keys, group], "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def action_evidence(findings: DataFrame, matches: DataFrame, *keys: str, item: str = "clause_id", group: str = "finding_type") -> DataFrame:
    """keys, ``group``, sr_id, framework, match_type, confidence, source_clause, place: the requirements that an action's clauses match, each by its first
    match in the order of clauses, numbered in that order. matches: keys, ``item``, sr_id, framework, match_type, match_confidence."""
    members = action_members(findings, *keys, item=item, group=group).select(*keys, group, item, "position")
    cited = members.join(matches.where("match_type <> 'NO_MATCH'").select(*keys, item, "sr_id", "framework", "match_type", "match_confidence"), [*keys, item])
    seen = F.struct("framework", "match_type", F.round(F.col("match_confidence") * 100).cast("int").alias("confidence"), F.col(item).alias("source_clause"))
    at = F.struct("position", "sr_id", -F.col("match_confidence"), "match_type")
    first = cited.groupBy(*keys, group, "sr_id").agg(F.min_by(seen, at).alias("_m"), F.min(at).alias("_at"))
    place = F.row_number().over(W.partitionBy(*keys, group).orderBy("_at"))  # a row for each requirement
    return first.select(*keys, group, "sr_id", "_m.*", place.alias("place"))


def action_texts(findings: DataFrame, proposals: DataFrame, *keys: str, item: str = "clause_id", group: str = "finding_type") -> DataFrame:
    """keys, ``group``, remediation_summary, negotiation_guidance, suggested_contract_change: the texts of an action's proposals, the most severe
    first, each once, joined by bars; the change is that of the first proposal. proposals: keys, ``item``, severity, problem_summary,
    negotiation_guidance, suggested_clause. A text that stands as a problem is not repeated as guidance."""
    members = action_members(findings, *keys, item=item, group=group).select(*keys, group, item, "position")
    place = F.struct(lookup({"HIGH": 0, "MEDIUM": 1, "LOW": 2}, F.col("severity"), 99).alias("rank"), "position", item)
    texts = ("problem_summary", "negotiation_guidance", "suggested_clause")
    rows = members.join(proposals.select(*keys, item, "severity", *texts), [*keys, item]).withColumn("_at", place)
    both = F.array(F.struct(F.lit(0).alias("kind"), F.trim("problem_summary").alias("text")), F.struct(F.lit(1).alias("kind"), F.trim("negotiation_guidance").alias("text")))
    texts = rows.select(*keys, group, "_at", F.inline(both)).where("text <> ''").groupBy(*keys, group, "text").agg(F.min(F.struct("_at", "kind")).alias("_f"))
    part = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_f.kind") == kind, F.struct("_f._at", "text")))), lambda x: x["text"]), " | ")
    joined = texts.groupBy(*keys, group).agg(part(0).alias("remediation_summary"), part(1).alias("negotiation_guidance"))
    first = rows.groupBy(*keys, group).agg(F.min_by(F.coalesce("suggested_clause", F.lit("")), "_at").alias("suggested_contract_change"))
    summary = F.coalesce(F.nullif("remediation_summary", F.lit("")), F.lit("See finding type."))
    return first.join(joined, [*keys, group], "left").withColumn("remediation_summary", summary).withColumn("negotiation_guidance", F.coalesce("negotiation_guidance", F.lit("")))


def exposure(members: DataFrame, evidence: DataFrame, action_key: str, *, strict: bool = False) -> DataFrame:
    """sr_id, n_clauses, n_actions: requirements by the clauses of the actions that cite them (strict: by the clauses that matched them).

    members: ``action_key``, clause_id; evidence: ``action_key``, sr_id, clause_id.
    """
    own = evidence.select(action_key, "sr_id", "clause_id").distinct()
    rows = own if strict else own.select(action_key, "sr_id").distinct().join(members.select(action_key, "clause_id").distinct(), action_key)
    return rows.groupBy("sr_id").agg(F.countDistinct("clause_id").alias("n_clauses"), F.countDistinct(action_key).alias("n_actions"))


def exposure_index(matches: DataFrame, members: DataFrame, evidence: DataFrame, items: DataFrame, *keys: str, item: str = "clause_id", group: str = "finding_type") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables about each requirement of keys: (framework, match_type, confidence of the first match), its clauses in order, its negotiation items in order.

    matches: keys, ``item``, position, sr_id, framework, match_type, match_confidence; members: ``action_members``; evidence: ``action_evidence``; items: keys,
    ``group``, item_id. Clauses that match come first, in the order of their positions, then those of the items that cite the requirement.
    """
    hits = matches.where("match_type <> 'NO_MATCH'")
    seen = F.struct("framework", "match_type", F.round(F.col("match_confidence") * 100).cast("int").alias("confidence"))
    head = hits.groupBy(*keys, "sr_id").agg(F.min_by(seen, F.struct("position", item)).alias("_m")).select(*keys, "sr_id", "_m.*")
    cited = evidence.select(*keys, group, "sr_id").join(items.select(*keys, group, "item_id"), [*keys, group])
    own = hits.select(*keys, "sr_id", item, F.struct(F.lit(0).alias("from"), F.lit("").alias("by"), "position").alias("at"))
    theirs = cited.join(members.select(*keys, group, item, "position"), [*keys, group]).select(*keys, "sr_id", item, F.struct(F.lit(1).alias("from"), F.col("item_id").alias("by"), "position").alias("at"))
    first = own.unionByName(theirs).groupBy(*keys, "sr_id", item).agg(F.min("at").alias("at"))
    return head, first, cited.select(*keys, "sr_id", "item_id").distinct()


def ranked_exposure(rows: DataFrame) -> DataFrame:
    """Adds rank: the most clauses first, then by requirement. A row for each requirement, so one task is enough."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_clauses"), "sr_id")))


def status_counts(findings: DataFrame, keys: list[str], column: str, values: list[str], other: str = "unknown") -> DataFrame:
    """Fixed buckets of counts by ``column``; null or unlisted values count as ``other``."""
    c = F.when(F.col(column).isin(*values), F.col(column)).otherwise(other)
    return findings.groupBy(*keys).agg(*[F.count_if(c == v).alias(f"n_{v.lower()}") for v in [*values, other]])


# Statuses of a finding under review.
BLOCKING = ("open", "in_review", "in_negotiation", "deferred")
CLOSED = ("resolved", "not_applicable", "accepted_risk")


def readiness(findings: DataFrame, *keys: str) -> DataFrame:
    """Approval readiness of each version: blocked by unresolved HIGH findings, else review_required by MEDIUM ones, else conditional while a
    HIGH or MEDIUM finding is in some other status, else ready. A null status is open."""
    status, sev = F.coalesce("status", F.lit("open")), F.upper(F.coalesce("severity", F.lit("")))
    blocking, closed = status.isin(*BLOCKING), status.isin(*CLOSED)
    out = findings.groupBy(*keys).agg(
        F.count_if((sev == "HIGH") & blocking).alias("high_open"),
        F.count_if((sev == "MEDIUM") & blocking).alias("medium_open"),
        F.count_if(~sev.isin("HIGH", "MEDIUM") & ~closed).alias("low_open"),
        F.count_if(status == "resolved").alias("resolved"),
        F.count_if(closed & (status != "resolved")).alias("accepted"),
        F.count("*").alias("total"),
        F.count_if(sev.isin("HIGH", "MEDIUM") & ~closed & ~blocking).alias("_other"),
    )
    level = F.when(F.col("high_open") > 0, "blocked").when(F.col("medium_open") > 0, "review_required").when(F.col("_other") > 0, "ready_for_conditional_approval")
    return out.withColumn("readiness", level.otherwise("ready_for_approval")).drop("_other")
