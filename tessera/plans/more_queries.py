"""Queries over elements, reports, model results and endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.operators import compliance as K
from tessera.operators import elements as E
from tessera.operators import reports as R
from tessera.operators import segments as S
from tessera.operators import store
from tessera.plans import text_queries as Q
from tessera.plans.registry import query, table, texts
from tessera.sources import files

_N = "CASE WHEN trim(regexp_replace(line, '\\s+', ' ', 'g'), ' ') = '' THEN 0 ELSE len(string_split(trim(regexp_replace(line, '\\s+', ' ', 'g'), ' '), ' ')) END"


@query(f"WITH {Q.LINES} SELECT doc_id, pos, CAST(CASE WHEN {_N} = 0 OR {_N} > 20 THEN NULL WHEN (8 + pos % 9) / 10.0::DOUBLE >= 1.5::DOUBLE THEN 1 WHEN (8 + pos % 9) / 10.0::DOUBLE >= 1.3::DOUBLE THEN 2 WHEN (8 + pos % 9) / 10.0::DOUBLE >= 1.2::DOUBLE THEN 3 WHEN regexp_matches(line, '^\\s*§\\s*\\d+') THEN 2 WHEN regexp_matches(line, '^\\s*(?:\\d+(?:\\.\\d+)*\\.?\\s+\\S|(?:section|article|clause|annex|schedule|artikel|abschnitt)\\s+\\S)', 'i') THEN CASE WHEN regexp_matches(line, '^\\s*\\d') THEN least(length(regexp_replace(regexp_extract(line, '^\\s*(\\d+(?:\\.\\d+)*)', 1), '[^.]', '', 'g')) + 1, 3) ELSE 2 END WHEN regexp_matches(line, '^\\s*\\(?[a-zA-Z]\\)\\s+\\S') AND {_N} <= 10 THEN 3 END AS INT) AS level, regexp_matches(line, ':\\s*$') AND {_N} <= 40 AS preamble FROM lines")
def p06_heading_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P06, P07 with sizes that follow the line's place."""
    rows = Q._lines(spark, sf_dir)
    return rows.select("doc_id", "pos", E.heading_level(F.col("line"), (8 + F.col("pos") % 9).cast("double"), F.lit(10.0)).cast("int").alias("level"), E.is_preamble(F.col("line")).alias("preamble"))


@query("WITH m AS (SELECT conv_id, turn, role = 'assistant' AS i, role = 'user' AS p FROM conversations), o AS (SELECT *, p AND coalesce(lead(i) OVER w, FALSE) AS opens, coalesce(lag(i) OVER w OR lag(p) OVER w, FALSE) AS before FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT *, i OR opens AS member, CASE WHEN opens OR (i AND NOT before) THEN 1 ELSE 0 END AS b FROM o) SELECT conv_id, turn, CAST(CASE WHEN member THEN sum(b) OVER (PARTITION BY conv_id ORDER BY turn) END AS BIGINT) AS list_group FROM b")
def w10_list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.list_groups(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant", F.col("role") == "user").select("conv_id", "turn", "list_group")


@query(f"WITH {Q.TOPICS} SELECT source, topic, count(*) AS issue_count, ['LOW', 'MEDIUM', 'HIGH'][max(CASE severity WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) + 1] AS highest_severity, count(DISTINCT doc_id) AS n_affected, array_to_string(list_sort(list_distinct(list(assessment))), ',') AS finding_types, count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium, CAST(row_number() OVER (PARTITION BY source ORDER BY max(CASE severity WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) DESC, CASE topic WHEN 'REGULATORY_COMPLIANCE' THEN 0 WHEN 'DATA_PROTECTION' THEN 1 WHEN 'SECURITY_CONTROLS' THEN 2 WHEN 'INCIDENT_MANAGEMENT' THEN 3 WHEN 'AUDIT_RIGHTS' THEN 4 WHEN 'SERVICE_LEVELS' THEN 5 ELSE 6 END, topic) AS INT) AS section FROM topics WHERE topic IS NOT NULL GROUP BY source, topic")
def a09_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09, O02, O03."""
    rows = Q._scores(spark, sf_dir).where("topic is not null").withColumn("clause_id", F.col("doc_id")).withColumnRenamed("assessment", "finding_type")
    out = R.brief(rows, "source")
    return out.select("source", "topic", "issue_count", "highest_severity", "n_affected", F.array_join("finding_types", ",").alias("finding_types"), "n_high", "n_medium", "section")


@query(f"WITH {Q.SCORES} SELECT source, count(*) AS total, count(*) FILTER (risk_score >= 7) AS high, count(*) FILTER (risk_score >= 4 AND risk_score < 7) AS medium, count(*) FILTER (risk_score < 4) AS low, count(*) FILTER (assessment = 'VALID') AS valid, count(*) FILTER (risk_score < 4) - count(*) FILTER (assessment = 'VALID') AS low_risk FROM scores GROUP BY source")
def a11_risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A08, A11, Q21."""
    return R.risk_distribution(Q._scores(spark, sf_dir), "source")


@query(f"WITH {Q.PLAN}, nums AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, max_score DESC, finding_type) AS action_no FROM plan), hits AS (SELECT DISTINCT source, doc_id, sr_id, framework FROM matches WHERE hits > 0), refs AS (SELECT n.source, n.action_no, list_sort(list_distinct(list(h.sr_id))) AS srs, list_sort(list_distinct(list(h.framework))) AS fws FROM (SELECT source, action_no, unnest(docs) AS doc_id FROM nums) n JOIN hits h USING (source, doc_id) GROUP BY ALL) SELECT source, printf('NEG-%03d', CAST(action_no AS INT)) AS item_id, ['HIGH', 'MEDIUM', 'LOW'][p + 1] AS priority, coalesce(array_to_string(srs[1:4], ','), '') AS evidence, coalesce(array_to_string(fws, ','), '') AS frameworks, CAST(len(docs) AS INT) AS n_clauses FROM nums LEFT JOIN refs USING (source, action_no)")
def j06_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J06, A29, W05."""
    matches = Q._matches(spark, sf_dir).withColumn("clause_id", F.col("doc_id")).select("source", "clause_id", "sr_id", "framework", "match_type").distinct()
    members = K.action_members(Q._rated(spark, sf_dir), "source", item="doc_id").withColumnRenamed("doc_id", "clause_id")
    out = R.package(Q._plan(spark, sf_dir), members, matches, "source")
    return out.select("source", "item_id", "priority", F.array_join("evidence", ",").alias("evidence"), F.array_join("frameworks", ",").alias("frameworks"), F.col("n_clauses").cast("int").alias("n_clauses"))


@query("WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), l AS (SELECT l_orderkey, arg_max(l_returnflag, struct_pack(a := l_linenumber, b := l_partkey, c := l_returnflag)) AS flag FROM lineitem GROUP BY l_orderkey), m AS (SELECT l_orderkey, count(*) AS n, arg_min(l_partkey, struct_pack(a := -l_discount, b := l_partkey)) AS best FROM lineitem WHERE l_discount > 0.05 GROUP BY l_orderkey) SELECT o_orderkey, o_orderstatus, l.flag, CAST(coalesce(n, 0) AS INT) AS n_matches, lpad(CAST(best AS VARCHAR), 12, '0') AS best_sr FROM o LEFT JOIN l ON o_orderkey = l.l_orderkey LEFT JOIN m ON o_orderkey = m.l_orderkey")
def j01_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of each key counts, matches stand best first."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "clause_id")
    clauses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clause_id"), "o_orderstatus")
    at = F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("position")
    none = li.select("clause_id", F.lit(0).alias("position")).where("false")
    matches = li.select("clause_id", F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("sr_id"), F.when(F.col("l_discount") > 0.05, "DIRECT_MATCH").otherwise("NO_MATCH").alias("match_type"), F.col("l_discount").alias("match_confidence"))
    out = R.trace(clauses, li.select("clause_id", F.col("l_returnflag").alias("flag"), at), matches, none, none)
    return out.select(F.col("clause_id").alias("o_orderkey"), "o_orderstatus", "flag", "n_matches", F.get("sr_matches", F.lit(0))["sr_id"].alias("best_sr"))


@query("WITH s AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS p FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(list_filter(p, lambda x: x NOT IN ('1-URGENT', '2-HIGH')), ',') AS unknown FROM s")
def u08_unknown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return rows.select("o_custkey", F.array_join(F.array_except("p", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))), ",").alias("unknown"))


@query("SELECT vec_id, CAST(round_even(vec_id::DOUBLE / 10, 0) AS BIGINT) AS y_row, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']' AS vector FROM embeddings")
def o12_spatial_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O12, F17."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", E.spatial_order(F.lit(0), F.col("vec_id").cast("double"))[0].cast("long").alias("y_row"), models.vector_text(F.col("embedding")).alias("vector"))


@query("""SELECT event_id, coalesce(event_type = 'purchase' AND value > 5, FALSE) AS matches, CASE WHEN event_type IN ('purchase', 'click') THEN CASE WHEN event_type = 'purchase' AND value > 5 THEN 'full' ELSE 'none' END ELSE 'none' END AS coverage, CAST(CASE WHEN event_type IN ('purchase', 'click') THEN 0.5 ELSE round(event_id % 100 / 100.0::DOUBLE * 0.5::DOUBLE, 4) END AS DOUBLE) AS confidence FROM events""")
def m04_validation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers come as JSON, the broken ones fall back."""
    e = table(spark, sf_dir, "events")
    full = F.when((F.col("event_type") == "purchase") & (F.col("value") > 5), "full").otherwise("none")
    answer = F.when(F.col("event_type").isin("purchase", "click"), F.format_string('{"matches": true, "coverage": "%s", "confidence": 0.5}', full)).when(F.col("event_type") == "view", "not json")
    return e.select("event_id", models.parse_validation(answer, F.col("event_id") % 100 / 100.0).alias("v")).select("event_id", "v.*")


@query("SELECT 'n_' || n_nationkey AS a, '    n_' || n_nationkey || ' -->|' || n_name || '| r_' || n_regionkey AS value, '| ' || n_nationkey || ' | ' || n_name || ' |' AS row FROM nation")
def s16_mermaid_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a graph and of a table."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n-"), "n_nationkey").alias("a"), F.concat(F.lit("r-"), "n_regionkey").alias("b"), "n_name", "n_nationkey")
    lines = files.mermaid_edges(n, "a", "b", "n_name").withColumn("a", F.regexp_extract("value", r"^ *(\S+)", 1))
    rows = files.markdown_table(n.select("n_nationkey", "n_name")).withColumn("a", F.concat(F.lit("n_"), F.regexp_extract("value", r"^\| (\d+)", 1))).withColumnRenamed("value", "row")
    return lines.join(rows, "a").select("a", "value", "row")


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776))), '‘’“”–—' || chr(160), '''''\"\"-- '), ' {2,}', ' ', 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') AS clean FROM documents")
def f01_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two letters are taken apart first, so that composition has work to do."""
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    return texts(spark, sf_dir).select("doc_id", S.normalise(apart).alias("clean"))


@query(f"WITH {Q.LINES}, m AS (SELECT doc_id, pos, CAST(floor(coalesce(sum(len(regexp_split_to_array(trim(line, ' '), '\\s+'))) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 500.0) + 1 AS BIGINT) AS page FROM lines) SELECT doc_id, page, count(*) AS n_lines, min(pos) AS first_pos FROM m GROUP BY ALL")
def s08_running_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 500 words, estimated by a running count."""
    before = F.coalesce(F.sum(F.size(F.split(F.trim("line"), r"\s+"))).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return Q._lines(spark, sf_dir).withColumn("page", E.running_page(before)).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"), F.min("pos").alias("first_pos"))


@query("WITH a AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), n AS (SELECT o_custkey, count(*) AS n_versions, count(*) FILTER (o_orderstatus = 'F') AS n_done FROM orders GROUP BY o_custkey) SELECT c_custkey, c_name, a.o_orderkey AS last_analysis, a.o_orderstatus AS status, coalesce(n_versions, 0) AS n_versions, coalesce(n_done, 0) AS n_done FROM customer LEFT JOIN a ON c_custkey = a.o_custkey LEFT JOIN n ON c_custkey = n.o_custkey WHERE c_nationkey = 3")
def api_list_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's contracts with their latest analysis and counts."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    last = store.latest(orders, ["c_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_custkey", F.col("o_orderkey").alias("last_analysis"), F.col("o_orderstatus").alias("status"))
    n = orders.groupBy("c_custkey").agg(F.count("*").alias("n_versions"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))
    mine = store.Tables({"customer": table(spark, sf_dir, "customer")}, 3, "c_nationkey")["customer"]
    return mine.join(last, "c_custkey", "left").join(n, "c_custkey", "left").select("c_custkey", "c_name", "last_analysis", "status", F.coalesce("n_versions", F.lit(0)).alias("n_versions"), F.coalesce("n_done", F.lit(0)).alias("n_done"))


@query("SELECT user_id, event_id, ts, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS step FROM events")
def api_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's history in order."""
    rows = table(spark, sf_dir, "events")
    return rows.select("user_id", "event_id", "ts", "event_type", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"))


@query("WITH v AS (SELECT o_custkey, min(o_orderkey) AS first_version FROM orders GROUP BY o_custkey) SELECT c_custkey, CAST(coalesce(first_version, -c_custkey) AS BIGINT) AS version_id, first_version IS NULL AS filled FROM customer LEFT JOIN v ON c_custkey = o_custkey")
def d06_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts without a version get one; the others are linked to their first."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_version"))
    return table(spark, sf_dir, "customer").join(first, "c_custkey", "left").select("c_custkey", F.coalesce("first_version", -F.col("c_custkey")).alias("version_id"), F.col("first_version").isNull().alias("filled"))


@query(f"WITH {Q.SIMILAR}, {Q._EXACT} SELECT count(*) AS n_expected, count(t.doc_id) AS n_found, CAST(round(count(t.doc_id)::DOUBLE / nullif(count(*), 0), 4) AS DOUBLE) AS recall FROM x LEFT JOIN top t ON x.doc_id = t.doc_id AND x.item_id = t.item_id")
def a19_shortlist_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q._similar(spark, sf_dir).select("doc_id", "item_id", F.lit(1).alias("hit"))
    return Q._exact(spark, sf_dir).join(found, ["doc_id", "item_id"], "left").agg(F.count("*").alias("n_expected"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), 4).alias("recall"))
