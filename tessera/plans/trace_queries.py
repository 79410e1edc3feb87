"""Queries over candidate metadata, model changes, review routing, traces, joined findings, cleaned and aggregated text.

Line items stand in for matches, orders for clauses and their findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import compliance as K
from tessera.operators import obligations as O  # noqa: E741
from tessera.operators import reports as R
from tessera.operators import segments as S
from tessera.operators import store
from tessera.operators import tracing as T
from tessera.plans import text_queries as Q
from tessera.plans.registry import query, table, texts


@query("WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount > 0.05 AS d, l_tax > 0.02 AS s, CAST(l_tax AS DOUBLE) * 10 AS score FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, d AS deterministic_candidate, s AS semantic_candidate, CASE WHEN s THEN score END AS semantic_score, CASE WHEN s THEN CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END END AS semantic_score_bucket, CASE WHEN d AND s THEN 'merged' WHEN d THEN 'deterministic' WHEN s THEN 'semantic' ELSE 'excluded' END AS candidate_source FROM m")
def p17_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16, P17."""
    c = T.candidate(F.col("l_discount") > 0.05, F.col("l_tax") > 0.02, F.col("l_tax").cast("double") * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", c.alias("c")).select("l_orderkey", "l_linenumber", "l_partkey", "c.*")


_TYPE = {"R": "NO_MATCH", "A": "PARTIAL_MATCH", "N": "DIRECT_MATCH"}
_BUCKET = "CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.6 THEN 'medium' WHEN c IS NOT NULL THEN 'low' END"


@query(f"WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS b, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS f, l_tax > 0.03 AS tried, CASE WHEN l_tax > 0.03 THEN CAST(l_discount AS DOUBLE) * 10 END AS c FROM lineitem), d AS (SELECT *, {_BUCKET} AS bucket, CASE WHEN NOT tried THEN NULL WHEN b = f THEN 'no_change' WHEN f > b THEN 'ai_upgrade' ELSE 'ai_downgrade' END AS delta FROM m) SELECT l_orderkey, l_linenumber, l_partkey, delta, bucket, CASE WHEN coalesce(bucket = 'low', FALSE) OR coalesce(delta IN ('ai_upgrade', 'ai_downgrade'), FALSE) THEN 'HIGH' WHEN coalesce(bucket = 'medium', FALSE) OR f = 1 THEN 'MEDIUM' ELSE 'LOW' END AS review FROM d")
def p19_match_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18 to P20 for matches."""
    before = K.lookup(_TYPE, F.col("l_returnflag"), "NO_MATCH")
    after, tried = F.when(F.col("l_linestatus") == "F", "PARTIAL_MATCH").otherwise("DIRECT_MATCH"), F.col("l_tax") > 0.03
    bucket, delta = O.confidence_bucket(F.when(tried, F.col("l_discount").cast("double") * 10)), T.match_delta(before, after, tried)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", delta.alias("delta"), bucket.alias("bucket"), T.match_review(after, bucket, delta).alias("review"))


@query("WITH p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'llm' WHEN 'F' THEN 'hybrid' ELSE 'rule_based' END AS src, CASE WHEN o_orderpriority[1:1] = '1' THEN 'OPERATIONAL_RISK' ELSE 'SCOPE_UNDEFINED' END AS kind, CASE WHEN o_custkey % 7 = 0 THEN ' ' ELSE 'clause' END AS clause, CASE WHEN o_orderkey % 3 = 0 THEN 'low' WHEN o_orderkey % 3 = 1 THEN 'medium' END AS bucket FROM orders) SELECT o_orderkey, CASE src WHEN 'hybrid' THEN 'no_change' WHEN 'llm' THEN 'ai_override' END AS delta, CASE WHEN coalesce(bucket = 'low', FALSE) OR trim(clause) = '' OR kind = 'OPERATIONAL_RISK' THEN 'HIGH' WHEN coalesce(bucket = 'medium', FALSE) THEN 'MEDIUM' ELSE 'LOW' END AS review, CASE WHEN src <> 'rule_based' THEN 'finding_type=' || kind || ';confidence=0.5;source=' || src END AS basis FROM p")
def p20_proposal_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19 to P21 for proposals."""
    source = F.when(F.col("o_orderstatus") == "O", "llm").when(F.col("o_orderstatus") == "F", "hybrid").otherwise("rule_based")
    kind = F.when(F.substring("o_orderpriority", 1, 1) == "1", "OPERATIONAL_RISK").otherwise("SCOPE_UNDEFINED")
    clause = F.when(F.col("o_custkey") % 7 == 0, " ").otherwise("clause")
    bucket = F.when(F.col("o_orderkey") % 3 == 0, "low").when(F.col("o_orderkey") % 3 == 1, "medium")
    trace = T.proposal_trace(source, kind, F.lit(0.5))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.proposal_delta(source).alias("delta"), T.proposal_review(kind, bucket, clause).alias("review"), F.array_join(trace["decision_basis"], ";").alias("basis"))


@query("SELECT doc_id, CASE WHEN lang <> 'en' THEN 'assessment=VALID;severity=LOW;confidence=None' END AS obligation_basis, CASE WHEN lang <> 'en' THEN array_to_string(string_split(text, ' ')[1:6], '|') END AS obligation_evidence, CASE WHEN lang <> 'en' THEN array_to_string(string_split(text, ' ')[1:4], '|') END AS match_evidence FROM documents")
def p21_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model answered for all documents but the English ones; the words of the text stand for its evidence."""
    source, words = F.when(F.col("lang") != "en", "llm").otherwise("rule_based"), F.split("text", " ")
    a = T.obligation_trace(source, F.lit("VALID"), F.lit("LOW"), F.lit(None).cast("double"), words)
    b = T.match_trace(source, F.lit("NO_MATCH"), F.lit("PARTIAL_MATCH"), F.lit(0.5), words)
    return texts(spark, sf_dir).select("doc_id", F.array_join(a["decision_basis"], ";").alias("obligation_basis"), F.array_join(a["evidence_tokens"], "|").alias("obligation_evidence"), F.array_join(b["evidence_tokens"], "|").alias("match_evidence"))


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_ART = "length({0}) < 4 OR regexp_matches({0}, '^\\s*[-–—]?\\s*\\d{{1,3}}\\s*[-–—]?\\s*$') OR regexp_matches({0}, '^(?:confidential|draft|version|revision|prepared\\s+by|date:|document\\s+id|page\\s+\\d|copyright|©|proprietary)[\\s:—\\-]*', 'i')".format(_STRIP.format("x"))
_CLEAN = f"regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: {_STRIP.format('x')} = '' OR NOT ({_ART})), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, {_STRIP.format(_CLEAN)} AS clean FROM documents")
def f02_clean_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", S.clean_clause(F.col("text")).alias("clean"))


@query("SELECT conv_id, coalesce(string_agg(coalesce(nullif(text, ''), nullif(role, '')), chr(10) || chr(10) ORDER BY turn, coalesce(nullif(text, ''), nullif(role, ''))), '') AS text FROM conversations GROUP BY conv_id")
def f04_aggregate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.aggregate_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "role")


@query(f"WITH e AS ({Q.EXPOSURE}) SELECT sr_id, n_clauses, n_actions, CAST(row_number() OVER (ORDER BY n_clauses DESC, sr_id) AS INT) AS rank FROM e")
def o05_exposure_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ranked_exposure(Q.a13_exposure(spark, sf_dir))


@query("WITH f AS (SELECT o_orderkey, CASE WHEN o_orderpriority[1:1] IN ('1', '2') THEN 'HIGH' WHEN o_orderpriority[1:1] = '3' THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS reason FROM orders), d AS (SELECT l_orderkey, arg_max(l_returnflag, struct_pack(a := l_linenumber, b := l_partkey, c := l_returnflag, d := l_linestatus)) AS reason, arg_max(l_linestatus, struct_pack(a := l_linenumber, b := l_partkey, c := l_returnflag, d := l_linestatus)) AS action FROM lineitem GROUP BY l_orderkey) SELECT f.o_orderkey, severity, coalesce(f.reason, d.reason) AS reason, d.action AS recommended_action FROM f LEFT JOIN d ON f.o_orderkey = d.l_orderkey WHERE severity <> 'LOW'")
def j02_finding_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of high and medium severity, what they lack from the last detail of their clause."""
    p = F.substring("o_orderpriority", 1, 1)
    findings = table(spark, sf_dir, "orders").select("o_orderkey", F.when(p.isin("1", "2"), "HIGH").when(p == "3", "MEDIUM").otherwise("LOW").alias("severity"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("reason"))
    details = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").alias("position"), F.col("l_returnflag").alias("reason"), F.col("l_linestatus").alias("recommended_action"))
    return R.with_details(findings, details, "o_orderkey", "reason", "recommended_action")


@query("WITH r AS (SELECT l_orderkey, arg_max(l_returnflag, struct_pack(a := l_linenumber, b := l_partkey, c := l_returnflag)) AS reason FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey), m AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_discount DESC, CAST(l_partkey AS VARCHAR)) AS srs FROM lineitem WHERE l_discount > 0.05 GROUP BY l_orderkey) SELECT o_orderkey, coalesce(r.reason, o_orderpriority) AS reason, coalesce(m.srs, '') AS srs, o_orderstatus AS clause_full_text FROM orders LEFT JOIN r ON o_orderkey = r.l_orderkey LEFT JOIN m ON o_orderkey = m.l_orderkey")
def j04_proposal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, orders = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), table(spark, sf_dir, "orders")
    reasons = li.where("l_linestatus = 'F'").select("o_orderkey", F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("position"), F.col("l_returnflag").alias("reason"))
    matches = li.select("o_orderkey", F.col("l_partkey").cast("string").alias("sr_id"), F.when(F.col("l_discount") > 0.05, "DIRECT_MATCH").otherwise("NO_MATCH").alias("match_type"), F.col("l_discount").alias("match_confidence"))
    out = R.proposal_findings(orders.select("o_orderkey", F.col("o_orderpriority").alias("preview")), reasons, matches, orders.select("o_orderkey", F.col("o_orderstatus").alias("clause_full_text")), "o_orderkey")
    return out.select("o_orderkey", "reason", F.array_join("sr_matches", ",").alias("srs"), "clause_full_text")


@query("WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) SELECT event_id, user_id, old AS old_status, 'uploaded' AS new_status, 'none' AS decision FROM m WHERE event_type = 'signup' AND old IS NOT NULL AND old <> 'error'")
def d05_reset_on_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups stand for uploads, errors for archived cases."""
    return store.reset_on_upload(table(spark, sf_dir, "events"), "user_id", "event_type", "signup", F.col("ts"), F.col("event_id"), archived="error").select("event_id", "user_id", "old_status", "new_status", "decision")
