"""Portfolio queries: latest rows, pages, gaps, upserts, state, comparisons, dashboards, library joins.

The supplied tables stand in: customers are tenants, orders are contracts' analyses, line items are findings, events are the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import compliance as K
from tessera.operators import library as L
from tessera.operators import matching as M
from tessera.operators import store
from tessera.operators.shared import ranked
from tessera.plans.registry import query, table
from tessera.streaming.review import Review, reviewed

_SEV = "CASE WHEN o_orderpriority[1:1] IN ('1', '2') THEN 'HIGH' WHEN o_orderpriority[1:1] = '3' THEN 'MEDIUM' ELSE 'LOW' END"
_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'accepted_risk' END"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings: key, severity, status."""
    p, s = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    sev = F.when(p.isin("1", "2"), "HIGH").when(p == "3", "MEDIUM").otherwise("LOW")
    return table(spark, sf_dir, "orders").withColumn("severity", sev).withColumn("status", F.when(s == "O", "open").when(s == "F", "resolved").otherwise("accepted_risk"))


@query("SELECT user_id, event_id, event_type, CAST(value AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def w01_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each key is that of its last event."""
    return store.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, rn = 1 AS is_best FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC NULLS LAST, l_extendedprice DESC, l_linenumber, l_partkey) AS rn FROM lineitem)")
def w02_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W02, J16, D07."""
    out = L.best_match(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.desc_nulls_last("l_discount"), F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "is_best")


@query("SELECT o_custkey, count(*) AS n_versions, max(o_orderkey) AS last_version, max(o_orderkey) + 1 AS next_version, count(*) FILTER (year(o_orderdate) = 1996) AS n_1996 FROM orders GROUP BY o_custkey")
def a23_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23, A30."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_versions"), F.max("o_orderkey").alias("last_version"), (F.max("o_orderkey") + 1).alias("next_version"), F.count_if(F.year("o_orderdate") == 1996).alias("n_1996"))


@query("SELECT p.p_partkey, p.p_brand FROM part p WHERE p.p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_partkey IS NOT NULL)")
def j13_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required rows that nothing covers."""
    covered = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45 and l_partkey is not null").select(F.col("l_partkey").alias("p_partkey"))
    return store.missing(table(spark, sf_dir, "part"), covered, ["p_partkey"]).select("p_partkey", "p_brand")


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def j14_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return store.missing(table(spark, sf_dir, "customer"), orders, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("WITH k AS (SELECT *, lower(trim(c_mktsegment)) || '__' || CAST(c_nationkey AS VARCHAR) AS finding_key FROM customer), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY finding_key ORDER BY c_custkey) = 1) SELECT finding_key, c_custkey, sha256(finding_key)[1:16] AS key_hash FROM f WHERE finding_key NOT IN (SELECT finding_key FROM k WHERE c_acctbal < -900)")
def j17_upsert_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17, D02, W14, U05, F11, F12."""
    keyed = table(spark, sf_dir, "customer").withColumn("finding_key", store.finding_key(F.col("c_mktsegment"), F.col("c_nationkey")))
    out = store.upsert_skip(keyed.where("c_acctbal < -900"), keyed, ["finding_key"], F.col("c_custkey"))
    return out.select("finding_key", "c_custkey", F.substring(F.sha2("finding_key", 256), 1, 16).alias("key_hash"))


@query(f"WITH f AS (SELECT *, {_SEV} AS severity, {_STATUS} AS status FROM orders) SELECT o_orderkey, severity, status, CAST(o_totalprice AS DOUBLE) AS o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER () AS total FROM f WHERE severity = 'HIGH' AND lower(status) LIKE '%o_e%n%' AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25")
def o08_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered page. The limit is the feature."""
    rows = _findings(spark, sf_dir).where((F.col("severity") == "HIGH") & store.contains_ci(F.col("status"), "O_E%N") & (F.col("o_totalprice") >= 1000))
    return store.page(rows, F.desc("o_totalprice"), F.col("o_orderkey"), offset=25).select("o_orderkey", "severity", "status", "o_totalprice", "place", "total")


@query("WITH l AS (SELECT doc_id, min(CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END) AS r FROM labels GROUP BY doc_id) SELECT d.doc_id, d.source, ['HIGH', 'MEDIUM', 'LOW'][r + 1] AS severity, row_number() OVER (ORDER BY r, d.n_chars DESC, d.doc_id) AS place, count(*) OVER () AS total FROM documents d JOIN l USING (doc_id) WHERE d.lang = 'en' AND contains(lower(d.text), 'thtion') AND EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = d.doc_id AND (x.quality = 0 OR x.toxic = 1 OR x.quality = 1))")
def p28_list_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have a label of some kind, each once, in a global order with the total."""
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").where((F.col("lang") == "en") & store.contains_ci(F.col("text"), "thtion")).select("doc_id", "source", "n_chars")
    worst = labels.groupBy("doc_id").agg(F.min(F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)).alias("r"))
    rows = store.present(rows, labels.where("quality = 0 or toxic = 1 or quality = 1"), ["doc_id"]).join(worst, "doc_id")
    out = ranked(rows, F.col("r"), F.desc("n_chars"), F.col("doc_id"), with_total=True)
    return out.select("doc_id", "source", F.element_at(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))), F.col("r") + 1).alias("severity"), "place", "total")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0")
def p31_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads through the tenant filter."""
    tables = store.Tables({"customer": table(spark, sf_dir, "customer")}, 7, "c_nationkey")
    return tables["customer"].where("c_acctbal > 0").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, r_name, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE p_size >= 40")
def j09_snowflake(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("part").where("p_size >= 40"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "r_name", "n_name")


@query("SELECT n.n_name, p.p_partkey, p.p_type FROM nation n JOIN part p ON p.p_size >= n.n_nationkey AND (p.p_brand = 'Brand#11' OR p.p_size % 5 = n.n_regionkey)")
def p13_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicability as a theta join with a small dimension."""
    n, p = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    fits = (F.col("p_size") >= F.col("n_nationkey")) & ((F.col("p_brand") == "Brand#11") | (F.col("p_size") % 5 == F.col("n_regionkey")))
    return p.join(n, fits).select("n_name", "p_partkey", "p_type")


@query("SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag)))::VARCHAR AS flags, list_sort(list_distinct(list(l_linestatus)))::VARCHAR AS statuses FROM lineitem GROUP BY l_orderkey")
def a24_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24, A29, J15."""
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return L.modifiers(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus").select("l_orderkey", text("l_returnflag").alias("flags"), text("l_linestatus").alias("statuses"))


@query("WITH p AS (SELECT l_orderkey, product(1 - l_discount) AS f FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) SELECT o_orderkey, CAST(round(coalesce(f, 1.0), 13) AS DOUBLE) AS penalty FROM orders LEFT JOIN p ON o_orderkey = l_orderkey")
def a25_penalty_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = L.penalty(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), (1 - F.col("l_discount")).alias("d")), "o_orderkey", "d")
    return table(spark, sf_dir, "orders").join(per, "o_orderkey", "left").select("o_orderkey", F.round(F.coalesce("factor", F.lit(1.0)), 13).alias("penalty"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE * l_discount * 10 + 0.45::DOUBLE * l_tax * 10 + 0.20::DOUBLE * CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END)), 4) AS DOUBLE) AS match_confidence, CASE WHEN l_quantity * 2 >= 80 THEN 'critical' WHEN l_quantity * 2 >= 60 THEN 'high' WHEN l_quantity * 2 >= 35 THEN 'medium' ELSE 'low' END AS severity, CAST(coalesce(nullif(l_discount, 0), nullif(l_tax, 0), 0) AS DOUBLE) AS quality FROM lineitem")
def p34_match_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P34, P35, P36, Q14."""
    band = F.when(F.col("l_returnflag") == "R", "strong").when(F.col("l_returnflag") == "A", "adequate")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", L.match_confidence(F.col("l_discount") * 10, F.col("l_tax") * 10, band).alias("match_confidence"), L.risk_severity(F.col("l_quantity") * 2).alias("severity"), L.quality(F.col("l_discount"), F.col("l_tax")).alias("quality"))


@query(f"WITH f AS (SELECT o_custkey, {_SEV} AS severity, {_STATUS} AS status FROM orders) SELECT o_custkey, CASE WHEN count(*) FILTER (severity = 'HIGH' AND status = 'open') > 0 THEN 'blocked' WHEN count(*) FILTER (severity = 'MEDIUM' AND status = 'open') > 0 THEN 'review_required' ELSE 'ready_for_approval' END AS readiness, count(*) FILTER (severity = 'HIGH' AND status = 'open') AS high_open, count(*) FILTER (severity = 'MEDIUM' AND status = 'open') AS medium_open, count(*) FILTER (severity = 'LOW' AND status = 'open') AS low_open, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'accepted_risk') AS accepted, count(*) AS total FROM f GROUP BY o_custkey")
def a22_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.readiness(_findings(spark, sf_dir), "o_custkey")


@query(f"WITH f AS (SELECT {_SEV} AS severity, {_STATUS} AS status FROM orders) SELECT severity, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'in_review') AS n_in_review, count(*) FILTER (status = 'resolved') AS n_resolved, count(*) FILTER (status NOT IN ('open', 'in_review', 'resolved')) AS n_unknown FROM f GROUP BY severity")
def a21_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.status_counts(_findings(spark, sf_dir), ["severity"], "status", ["open", "in_review", "resolved"])


@query(f"WITH f AS (SELECT o_custkey, {_SEV} AS severity, o_totalprice FROM orders), c AS (SELECT c_nationkey, n_name, max(CASE severity WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS level, count(*) AS n_findings, round(avg(o_totalprice), 1) AS avg_score FROM f JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT n_name, CAST(level AS INT) AS level, n_findings, CAST(avg_score AS DOUBLE) AS avg_score FROM c ORDER BY level DESC, n_findings DESC, n_name LIMIT 10")
def a20_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten riskiest groups. The limit is the feature."""
    rows = _findings(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = rows.groupBy("c_nationkey", "n_name").agg(F.max(K.rank(F.col("severity"))).alias("level"), F.count("*").alias("n_findings"), F.round(F.avg("o_totalprice"), 1).alias("avg_score"))
    return out.orderBy(F.desc("level"), F.desc("n_findings"), "n_name").limit(10).select("n_name", "level", "n_findings", "avg_score")


@query("WITH b AS (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0), a AS (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 1) SELECT coalesce(b.user_id, a.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'new' WHEN a.user_id IS NULL THEN 'resolved' ELSE 'unchanged' END AS change FROM b FULL JOIN a ON a.user_id = b.user_id")
def u03_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two versions are the even and the odd events."""
    e = table(spark, sf_dir, "events")
    return store.compare(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id")


@query("SELECT user_id AS id, 'event' AS kind, event_type AS what, ts AS at FROM events UNION ALL SELECT o_custkey, 'order', o_orderstatus, o_orderdate FROM orders")
def u06_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U04, U06, P39."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.lit("event").alias("kind"), F.col("event_type").alias("what"), F.col("ts").alias("at"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderstatus").alias("what"), F.col("o_orderdate").alias("at"))
    return e.unionByName(o)


@query("WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) SELECT event_id, user_id, f AS from_state, event_type AS to_state FROM m WHERE f IS NOT NULL AND NOT ((f = 'signup' AND event_type IN ('view', 'click')) OR (f = 'view' AND event_type IN ('click', 'view')) OR (f = 'click' AND event_type IN ('purchase', 'view', 'click')) OR f = 'purchase')")
def p38_illegal_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves that the transition table does not allow."""
    kinds = ("signup", "view", "click", "purchase", "error")
    allowed = [("signup", "view"), ("signup", "click"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("click", "click"), *(("purchase", k) for k in kinds)]
    rules = spark.createDataFrame(allowed, "from_state string, to_state string")
    return store.illegal_moves(table(spark, sf_dir, "events"), rules, "user_id", "event_type", F.col("ts"), F.col("event_id")).select("event_id", "user_id", "from_state", "to_state")


@query("SELECT l_orderkey, l_linenumber, l_partkey, v AS violation FROM (SELECT *, unnest([CASE WHEN NOT l_quantity <= 45 THEN 'quantity' END, CASE WHEN NOT l_discount <= 0.08 THEN 'discount' END, CASE WHEN NOT (l_returnflag <> 'R' OR l_linestatus = 'F') THEN 'returned_open' END]) AS v FROM lineitem) WHERE v IS NOT NULL")
def s12_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12 and the CHECK rules of the data model."""
    checks = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") <= 0.08, "returned_open": (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F")}
    return store.violations(table(spark, sf_dir, "lineitem"), checks, "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, u1.c_name AS reviewer, u2.c_name AS assignee FROM orders LEFT JOIN customer u1 ON u1.c_custkey = o_custkey LEFT JOIN customer u2 ON u2.c_custkey = o_custkey + 1")
def j19_two_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    a, b = (c.select(F.col("c_custkey").alias(f"k_{n}"), F.col("c_name").alias(n)) for n in ("reviewer", "assignee"))
    return table(spark, sf_dir, "orders").join(a, F.col("o_custkey") == F.col("k_reviewer"), "left").join(b, F.col("o_custkey") + 1 == F.col("k_assignee"), "left").select("o_orderkey", "reviewer", "assignee")


@query("SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line, arg_min(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS first_part, arg_max(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS last_part, CAST(median(l_quantity) AS DOUBLE) AS median_quantity, CASE WHEN bool_or(l_returnflag = 'R') THEN 'ocr_text' ELSE 'paragraph' END AS layout FROM lineitem GROUP BY l_orderkey")
def a28_chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26, A27, A28."""
    at = F.struct("l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"), F.min_by("l_partkey", at).alias("first_part"), F.max_by("l_partkey", at).alias("last_part"), F.median("l_quantity").alias("median_quantity"), F.when(F.bool_or(F.col("l_returnflag") == "R"), "ocr_text").otherwise("paragraph").alias("layout"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, printf('%03d', CAST(event_id % 1000 AS INT)) AS padded, strftime(ts, '%Y%m%d') AS day, CAST(year(ts) AS INT) AS y FROM events")
def f13_json_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F09, F13, F16."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.format_string("%03d", F.col("event_id") % 1000).alias("padded"), F.date_format("ts", "yyyyMMdd").alias("day"), F.year("ts").alias("y"))


@query("WITH t AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS open FROM orders GROUP BY ALL) SELECT o_custkey, '{' || string_agg('\"' || o_orderpriority || '\":' || n, ',' ORDER BY o_orderpriority) || '}' AS doc, CAST(any_value(open) AS INT) AS has_open FROM t JOIN p USING (o_custkey) GROUP BY o_custkey")
def a31_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each contract."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.max((F.col("o_orderstatus") == "O").cast("int")).alias("open"))
    return per.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderpriority", "n"))))).alias("doc"), F.max("open").alias("has_open"))


@query("WITH f AS (SELECT s_nationkey, l_suppkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT coalesce(CAST(s_nationkey AS VARCHAR), 'all') AS framework, coalesce(CAST(l_suppkey AS VARCHAR), 'all') AS sr, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ROLLUP (s_nationkey, l_suppkey)")
def a02_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement, framework and whole in one pass."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.rollup("s_nationkey", "l_suppkey").agg(F.count("*").alias("n")).select(F.coalesce(F.col("s_nationkey").cast("string"), F.lit("all")).alias("framework"), F.coalesce(F.col("l_suppkey").cast("string"), F.lit("all")).alias("sr"), "n")


@query("WITH p AS (SELECT l_orderkey, l_partkey, max(l_discount) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), e AS (SELECT l_orderkey, l_partkey, max(l_discount) AS d FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), j AS (SELECT p.d AS a, e.d AS b FROM p FULL JOIN e ON p.l_orderkey = e.l_orderkey AND p.l_partkey = e.l_partkey), s AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND a = b) AS tp, count(*) FILTER (a IS NOT NULL AND NOT coalesce(a = b, FALSE)) AS fp, count(*) FILTER (b IS NOT NULL AND NOT coalesce(a = b, FALSE)) AS fn FROM j) SELECT tp, fp, fn, CAST(round(tp::DOUBLE / nullif(tp + fp, 0), 4) AS DOUBLE) AS precision, CAST(round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS DOUBLE) AS recall, CAST(round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 4) AS DOUBLE) AS f1 FROM s")
def a18_strict_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, J20 with equal types asked for."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus").agg(F.max("l_discount").alias("match_type"))
    part = lambda c: rows.where(c).groupBy("l_orderkey", "l_partkey").agg(F.max("match_type").alias("match_type"))
    return M.evaluate(part("l_returnflag = 'R'"), part("l_linestatus = 'F'"), ["l_orderkey", "l_partkey"], strict=True)


@query("WITH RECURSIVE n AS (SELECT user_id, event_id, ts, event_type AS asked, ['ADMIN', 'ANALYST', 'VIEWER'][event_id % 3 + 1] AS role, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), walk AS (SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, 'view' AS old_status, 'view' AS new_status, '' AS outcome, 0::BIGINT AS snapshot FROM (SELECT DISTINCT user_id FROM n) UNION ALL SELECT user_id, k, event_id, s, CASE WHEN said = 'accepted' THEN asked ELSE s END, said, snapshot + CASE WHEN said = 'accepted' THEN 1 ELSE 0 END FROM (SELECT n.*, w.new_status AS s, w.snapshot, CASE WHEN w.new_status = 'error' THEN 'final' WHEN n.asked = w.new_status THEN 'unchanged' WHEN n.role = 'VIEWER' OR (n.asked = 'error' AND n.role <> 'ADMIN') THEN 'role' WHEN n.asked = 'purchase' AND w.new_status <> 'click' THEN 'move' ELSE 'accepted' END AS said FROM walk w JOIN n ON n.user_id = w.user_id AND n.k = w.k + 1)) SELECT user_id, event_id, old_status, new_status, outcome, snapshot FROM walk WHERE k > 0")
def d04_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user accepted or refused by state and role, a snapshot for each accepted one."""
    rules = Review("view", {"purchase": ("click",)}, {"error": ("ADMIN",)}, ("VIEWER",), ("error",))
    role = F.element_at(F.array(*map(F.lit, ("ADMIN", "ANALYST", "VIEWER"))), (F.col("event_id") % 3 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("at"), F.col("event_type").alias("asked"), role.alias("role"))
    return reviewed(events, "user_id", rules).drop("at")
