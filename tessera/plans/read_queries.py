"""Queries of review screens and of applicability, over the supplied tables in the roles of ``store_queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import prompts as P
from tessera.operators import compliance as K
from tessera.operators import elements as E
from tessera.operators import library as L
from tessera.operators import matching as M
from tessera.operators import reads as R
from tessera.operators import render as RD
from tessera.operators import reports as RP
from tessera.operators import store
from tessera.operators.shared import ranked
from tessera.plans import demo
from tessera.plans import text_queries as Q
from tessera.plans.registry import query, table, texts
from tessera.plans.store_queries import _SEV, _STATUS, _findings


@query("WITH c AS (SELECT c_custkey, c_mktsegment AS t, c_custkey % 3 AS tier, unnest(list_distinct([c_nationkey % 5, (c_nationkey + 1) % 5])) AS f FROM customer), r AS (SELECT n_nationkey, n_regionkey AS f, n_nationkey % 3 AS min_rank, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE ['BUILDING', 'MACHINERY', 'AUTOMOBILE'][1 + n_nationkey % 2 : 2 + n_nationkey % 2] END AS ts FROM nation) SELECT c_custkey, n_nationkey FROM c JOIN r USING (f) WHERE (ts IS NULL OR list_contains(ts, t)) AND tier >= min_rank")
def p13_applicable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements that apply to each contract, by framework, type and tier. Customers are contracts, nations requirements."""
    n, even = F.col("c_nationkey"), F.col("n_nationkey") % 2 == 0
    kinds = F.when(F.col("n_nationkey") % 3 != 0, F.when(even, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).otherwise(F.array(F.lit("MACHINERY"), F.lit("AUTOMOBILE"))))
    contracts = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("contract_type"), (F.col("c_custkey") % 3).alias("tier_rank"), F.array(n % 5, (n + 1) % 5).alias("frameworks"))
    requirements = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("framework"), (F.col("n_nationkey") % 3).alias("min_rank"), kinds.alias("contract_types"))
    return M.applicable_rows(requirements, contracts).select("c_custkey", "n_nationkey")


_SNIP = "CASE WHEN strpos(lower(text), '{0}') > 0 THEN trim(replace(text[greatest(strpos(lower(text), '{0}') - 50, 1) : strpos(lower(text), '{0}') + {1}], chr(10), ' '), ' ') END"
_PARTS = ("attion", "nicht", "avec")


@query(f"WITH s AS (SELECT doc_id, {', '.join(f'{_SNIP.format(p, len(p) + 99)} AS s{i}' for i, p in enumerate(_PARTS))} FROM documents), j AS (SELECT doc_id, array_to_string(list_filter([s0, CASE WHEN s1 IS DISTINCT FROM s0 THEN s1 END, CASE WHEN s2 IS DISTINCT FROM s0 AND s2 IS DISTINCT FROM s1 THEN s2 END], lambda x: x IS NOT NULL), ' … ') AS e FROM s) SELECT doc_id, CASE WHEN length(coalesce(e, '')) > 200 THEN e[1:197] || '…' ELSE coalesce(e, '') END AS evidence FROM j")
def p15_evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of several patterns, distinct, joined, cut at 200 characters."""
    return texts(spark, sf_dir).select("doc_id", M.evidence(F.col("text"), _PARTS, limit=200).alias("evidence"))


@query(f"WITH f AS (SELECT {_SEV} AS severity, {_STATUS} AS status, CAST(year(o_orderdate) AS VARCHAR) AS y, CASE WHEN o_totalprice >= 200000 THEN ['large', 'whole'] WHEN o_totalprice >= 1000 THEN ['whole'] ELSE [] END AS tags FROM orders), p AS (SELECT 'severity' AS panel, severity AS value FROM f UNION ALL SELECT 'status', status FROM f UNION ALL SELECT 'year', y FROM f UNION ALL SELECT 'tags', unnest(CASE WHEN len(tags) = 0 THEN ['OTHER'] ELSE tags END) FROM f) SELECT panel, coalesce(value, 'OTHER') AS value, count(*) AS n FROM p GROUP BY ALL")
def a20_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's counts in one pass."""
    rows, price = _findings(spark, sf_dir), F.col("o_totalprice")
    tags = F.when(price >= 200000, F.array(F.lit("large"), F.lit("whole"))).when(price >= 1000, F.array(F.lit("whole"))).otherwise(F.array().cast("array<string>"))
    return R.panels(rows, {"severity": F.col("severity"), "status": F.col("status"), "year": F.year("o_orderdate"), "tags": tags})


@query(f"WITH f AS (SELECT o_custkey, o_orderkey, {_SEV} AS severity, {_STATUS} AS status FROM orders) SELECT o_custkey, o_orderkey, severity, status, CAST(row_number() OVER w AS INT) AS place FROM f WHERE severity <> 'LOW' AND status = 'open' WINDOW w AS (PARTITION BY o_custkey ORDER BY severity = 'HIGH' DESC, o_orderkey) QUALIFY place <= 20")
def a22_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 reasons against approval. The limit is the feature."""
    return R.blocking_reasons(_findings(spark, sf_dir), "o_custkey", finding="o_orderkey")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model stands in that refuses lines at places divisible by 5 and makes partial matches at odd places direct."""
    rows = Q._matches(spark, sf_dir).withColumnRenamed("match_type", "pattern_type")
    said = F.when(F.col("pos") % 5 == 0, "NO_MATCH").when((F.col("pattern_type") == "PARTIAL_MATCH") & (F.col("pos") % 2 == 1), "DIRECT_MATCH").otherwise(F.col("pattern_type"))
    return rows.withColumn("match_type", said)


_VERDICTS = f"{Q.MATCHES}, details AS (SELECT * EXCLUDE (match_type), match_type AS pattern_type, CASE WHEN pos % 5 = 0 THEN 'NO_MATCH' WHEN match_type = 'PARTIAL_MATCH' AND pos % 2 = 1 THEN 'DIRECT_MATCH' ELSE match_type END AS match_type FROM matches)"
_PROMOTED, _REFUSED = "match_type = 'DIRECT_MATCH' AND pattern_type <> 'DIRECT_MATCH'", "match_type = 'NO_MATCH' AND pattern_type <> 'NO_MATCH'"


@query(f"WITH {_VERDICTS} SELECT sr_id, count(*) FILTER (match_type = 'DIRECT_MATCH') AS n_direct, count(*) FILTER (match_type = 'PARTIAL_MATCH') AS n_partial, count(*) FILTER (match_type = 'NO_MATCH') AS n_none, count(*) FILTER ({_PROMOTED}) AS n_promoted, count(*) FILTER ({_REFUSED}) AS n_refused, CAST(round(avg(match_confidence) FILTER (match_type <> 'NO_MATCH'), 4) AS DOUBLE) AS avg_confidence FROM details GROUP BY sr_id")
def a15_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_metrics(_verdicts(spark, sf_dir).withColumn("match_confidence", F.col("match_confidence").cast("double")), "sr_id")


@query(f"WITH {_VERDICTS} SELECT doc_id, pos, sr_id, CASE WHEN {_REFUSED} THEN 'false_positive' ELSE 'promoted' END AS kind FROM details WHERE ({_REFUSED}) OR ({_PROMOTED})")
def a15_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that the run promoted, and false positives of the patterns."""
    rows = _verdicts(spark, sf_dir).where(R.promoted() | R.refused())
    return rows.select("doc_id", "pos", "sr_id", F.when(R.refused(), "false_positive").otherwise("promoted").alias("kind"))


@query("WITH l AS (SELECT l_orderkey, arg_max(struct_pack(s := l_suppkey, q := l_quantity), struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_quantity)) AS x, count(*) AS n FROM lineitem GROUP BY l_orderkey), r AS (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey), e AS (SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS t FROM events GROUP BY user_id) SELECT o_orderkey, c_name, x.s AS last_supplier, CAST(x.q AS DOUBLE) AS last_quantity, t AS last_event, d AS last_return, coalesce(n, 0) AS n_findings FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l.l_orderkey = o_orderkey LEFT JOIN r ON r.l_orderkey = o_orderkey LEFT JOIN e ON user_id = o_orderkey")
def j08_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with the last row of each of four details and their number of findings."""
    li, order = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), table(spark, sf_dir, "orders")
    clauses = order.select("o_orderkey", "o_custkey")
    people = order.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")
    last = li.select("o_orderkey", "l_suppkey", "l_quantity", "l_linenumber", "l_partkey")
    returned = li.where("l_returnflag = 'R'").select("o_orderkey", "l_shipdate")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_orderkey"), "event_type", "ts", "event_id")
    details = {
        "who": (people, F.col("c_name")),
        "last": (last, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")),
        "back": (returned, F.col("l_shipdate")),
        "event": (events, F.struct("ts", "event_id")),
    }
    out = R.explorer(clauses, details, li, "o_orderkey")
    return out.select("o_orderkey", "who.c_name", F.col("last.l_suppkey").alias("last_supplier"), F.col("last.l_quantity").alias("last_quantity"), F.col("event.event_type").alias("last_event"), F.col("back.l_shipdate").alias("last_return"), "n_findings")


_ELEMENTS = f"{Q.LINES}, elements AS (SELECT doc_id, pos // 40 AS chunk, pos, line, CASE WHEN contains(line, '|') THEN 'table' WHEN length(line) < 30 THEN 'heading' WHEN contains(line, '!!!') THEN 'ocr_text' ELSE 'paragraph' END AS layout, 8.0::DOUBLE + length(line) % 5 AS font, CASE WHEN contains(line, '!') THEN (length(line) % 10) / 10.0::DOUBLE END AS conf FROM lines)"


@query(f"WITH {_ELEMENTS}, shown AS (SELECT doc_id, chunk, layout, count(*) AS n, min(pos) AS f FROM elements GROUP BY ALL), lay AS (SELECT doc_id, chunk, CASE WHEN bool_or(layout = 'ocr_text') THEN 'ocr_text' ELSE arg_max(layout, struct_pack(a := n, b := -f)) END AS layout FROM shown GROUP BY ALL), sized AS (SELECT doc_id, chunk, font, sum(length(line)) AS n FROM elements GROUP BY ALL), main AS (SELECT doc_id, chunk, arg_max(font, struct_pack(a := n, b := -font)) AS main_font FROM sized GROUP BY ALL), rest AS (SELECT doc_id, chunk, CAST(round(avg(conf), 4) AS DOUBLE) AS confidence, CAST(median(font) AS DOUBLE) AS median_font FROM elements GROUP BY ALL) SELECT doc_id, CAST(chunk AS INT) AS chunk, layout, main_font, confidence, median_font FROM lay JOIN main USING (doc_id, chunk) JOIN rest USING (doc_id, chunk)")
def a26_chunk_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant layout, fonts and confidence of chunks of 40 lines."""
    line, n = F.col("line"), F.length("line")
    kind = F.when(line.contains("|"), "table").when(n < 30, "heading").when(line.contains("!!!"), "ocr_text").otherwise("paragraph")
    rows = Q._lines(spark, sf_dir).select("doc_id", F.floor(F.col("pos") / 40).cast("int").alias("chunk"), "pos", line.alias("text"), kind.alias("layout"), (8.0 + n % 5).alias("font"), F.when(line.contains("!"), (n % 10) / F.lit(10.0)).alias("ocr_confidence"))
    return R.chunk_facts(rows, "doc_id", "chunk")


_CUT = "CASE WHEN length(p) > {0} THEN p[1:{0}] || '…' ELSE p END AS p{0}"


@query(f"WITH t AS (SELECT doc_id, trim(replace(coalesce(text, ''), chr(10), ' '), ' ') AS p FROM documents) SELECT doc_id, {', '.join(_CUT.format(n) for n in (120, 160, 180, 200, 300))}, p[1:140] || '…' AS p140, p[1:500] AS p500 FROM t")
def p27_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms of preview; they are cut texts by definition."""
    t = F.coalesce("text", F.lit(""))
    forms = {f"p{n}": R.preview(t, n) for n in (120, 160, 180, 200, 300)} | {"p140": R.preview(t, 140, always=True), "p500": R.preview(t, 500, always=True, mark="")}
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in forms.items()])


@query(f"WITH f AS (SELECT o_custkey, {_SEV} AS severity, o_totalprice AS score, year(o_orderdate) % 2 = 0 AS b FROM orders), s AS (SELECT o_custkey, count(*) FILTER (b) AS n_before, count(*) FILTER (b AND severity = 'HIGH') AS high_before, CAST(round(avg(score) FILTER (b), 6) AS DOUBLE) AS score_before, count(*) FILTER (NOT b) AS n_after, count(*) FILTER (NOT b AND severity = 'HIGH') AS high_after, CAST(round(avg(score) FILTER (NOT b), 6) AS DOUBLE) AS score_after FROM f GROUP BY o_custkey) SELECT *, n_after - n_before AS n_change, high_after - high_before AS high_change FROM s")
def j21_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of two versions side by side; even years are the first version."""
    even = F.year("o_orderdate") % 2 == 0
    return R.side_by_side(_findings(spark, sf_dir).withColumn("score", F.col("o_totalprice")), even, ~even, "o_custkey")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no list of clauses' WHEN 2 THEN 'no flag of content' WHEN 3 THEN 'a clause lacks a field' WHEN 4 THEN 'a clause without text' END AS problem, CAST(CASE WHEN event_id % 6 = 5 THEN 1 + event_id % 2 END AS INT) AS n_clauses FROM events")
def p37_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers checked; each event's kind and number make up an answer with one fault or none."""
    fault = F.col("event_id") % 6
    text = F.when(fault == 4, " ").otherwise(F.concat("event_type", F.lit(" "), F.col("event_id")))
    clause = F.struct(text.alias("clause_text"), F.lit(0).alias("starts_at_char"), F.when(fault != 3, F.length(text)).alias("ends_at_char"), F.lit(False).alias("is_continuation"), F.lit(True).alias("is_truncated"))
    listed = F.when(F.col("event_id") % 2 == 1, F.array(clause, clause)).otherwise(F.array(clause))
    whole = F.to_json(F.struct(F.when(fault != 1, listed).alias("clauses"), F.when(fault != 2, F.lit(True)).alias("chunk_has_operative_content")))
    answer = F.when(fault == 0, F.substring(whole, 1, 9)).otherwise(whole)
    checked = table(spark, sf_dir, "events").select("event_id", P.extraction_answer(answer).alias("x"))
    return checked.select("event_id", "x.problem", F.when(F.col("x.clauses").isNotNull(), F.size("x.clauses")).alias("n_clauses"))


@query("WITH m AS (SELECT l_orderkey, l_partkey % 7 AS req, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS clause_id, CASE l_returnflag WHEN 'R' THEN 'full' WHEN 'A' THEN 'partial' ELSE 'none' END AS coverage, l_discount * 10 AS mc, l_tax AS sim, l_quantity / 50 AS raw, CASE WHEN l_linenumber % 2 = 0 THEN 'term; scope' ELSE '' END AS lacking, l_linenumber, l_partkey FROM lineitem), p AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS clause_id, product(1 - l_tax * 5) AS f FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT * FROM m WHERE coverage <> 'none' QUALIFY row_number() OVER (PARTITION BY l_orderkey, req ORDER BY mc DESC, sim DESC, raw DESC, clause_id) = 1), r AS (SELECT b.*, raw * coalesce(f, 1.0) AS post FROM b LEFT JOIN p USING (clause_id) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F' AND req = o_orderkey % 7)), k AS (SELECT *, round(100 * (1 - coalesce(nullif(post, 0), nullif(raw, 0), 0)), 2) AS risk FROM r) SELECT l_orderkey, req, clause_id, CASE coverage WHEN 'full' THEN 'present' ELSE 'partial' END AS finding_type, CASE WHEN risk >= 80 THEN 'critical' WHEN risk >= 60 THEN 'high' WHEN risk >= 35 THEN 'medium' ELSE 'low' END AS severity, CAST(round(coalesce(nullif(mc, 0), 0.5), 6) AS DOUBLE) AS confidence, CASE WHEN coverage = 'full' THEN 'No action required.' WHEN lacking <> '' THEN 'Add: ' || lacking ELSE 'Clarify the clause.' END AS recommendation FROM k")
def d07_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best matches that become findings, unless there is one."""
    li = table(spark, sf_dir, "lineitem").withColumn("clause_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")).withColumn("req", F.col("l_partkey") % 7)
    coverage = F.when(F.col("l_returnflag") == "R", "full").when(F.col("l_returnflag") == "A", "partial").otherwise("none")
    lacking = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("term"), F.lit("scope")))
    matches = li.select("l_orderkey", "req", "clause_id", coverage.alias("coverage"), (F.col("l_discount") * 10).alias("match_confidence"), F.lit(0.0).alias("model_confidence"), F.col("l_tax").alias("similarity"), (F.col("l_quantity") / 50).alias("raw_quality"), lacking.alias("missing_elements"))
    penalties = li.where("l_linestatus = 'F'").select("clause_id", (1 - F.col("l_tax") * 5).alias("factor"))
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7).alias("req"), F.lit("present").alias("finding_type"))
    out = L.promote(matches, penalties, held, ["l_orderkey", "req"], F.desc("raw_quality"), F.col("clause_id"))
    return out.select("l_orderkey", "req", "clause_id", "finding_type", "severity", F.round("confidence", 6).alias("confidence"), "recommendation")


@query("SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 2 = 0 THEN text END, ''), nullif(CASE WHEN turn % 3 = 0 THEN '' END, ''), nullif(role, '')) AS shown FROM conversations")
def p24_first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.when(F.col("turn") % 2 == 0, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", RP.first_filled(even, F.when(F.col("turn") % 3 == 0, ""), F.col("role")).alias("shown"))


@query(f"WITH {Q.LINES}, n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id), s AS (SELECT doc_id, pos, line, sum(CASE WHEN n >= 3 AND pos > 0 AND {Q._hit('trim(line)', E.NUMBERED, '')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM lines JOIN n USING (doc_id)) SELECT doc_id, CAST(part AS BIGINT) AS part, string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY ALL")
def w07_split_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents cut before each numbered heading."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), "text")
    return E.split_internal(rows, "doc_id", "pos", "text").select("doc_id", "part", "text")


@query(f"WITH f AS (SELECT o_custkey, o_orderkey, {_SEV} AS severity FROM orders) SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS proposal FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, o_orderkey) = 1")
def o11_primary_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _findings(spark, sf_dir).select("o_custkey", "severity", F.col("o_orderkey").alias("position"), F.col("o_orderkey").cast("string").alias("proposal"))
    return RP.primary_proposal(rows, "o_custkey")


@query(f"WITH {Q.SCORES} SELECT doc_id, pos, CAST(risk_score AS DOUBLE) AS risk_score, row_number() OVER (ORDER BY risk_score DESC, doc_id, pos) AS place FROM scores")
def o01_risk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses by risk, the place of each in the whole table."""
    return ranked(Q._scores(spark, sf_dir).select("doc_id", "pos", F.col("risk_score").cast("double").alias("risk_score")), F.desc("risk_score"), F.col("doc_id"), F.col("pos"))


@query(f"WITH f AS (SELECT o_custkey, o_orderkey, o_orderdate, {_SEV} AS severity, {_STATUS} AS status FROM orders) SELECT o_custkey, o_orderkey, status, count(*) FILTER (status = 'open') OVER (PARTITION BY o_custkey) AS n_open, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS step FROM f WHERE severity = 'HIGH'")
def p39_open_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one priority, how many are open, newest first."""
    return R.by_priority(_findings(spark, sf_dir), "HIGH", ["o_custkey"], F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "status", "n_open", "step")


@query("SELECT l_orderkey, l_linenumber, l_partkey, '{\"q\":' || CAST(l_linenumber AS VARCHAR) || ',\"parts\":[{\"flag\":\"' || l_returnflag || '\"}]}' AS doc FROM lineitem")
def p33_public_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal fields go at any depth."""
    part = F.struct(F.col("l_returnflag").alias("flag"), F.col("l_tax").alias("_tax"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(1).alias("_row"), F.struct(F.col("l_linenumber").alias("q"), F.lit("x").alias("_why"), F.array(part).alias("parts")).alias("doc"))
    return store.strip_internal(rows).withColumn("doc", F.to_json("doc"))


_TITLES = "CASE sr_id " + " ".join(f"WHEN '{r.sr_id}' THEN '{r.title.lower()}'" for r in demo.CATALOGUE) + " END"


@query(f"WITH {Q.SCORES}, m AS (SELECT doc_id, pos, framework, {_TITLES} AS title FROM matches WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY match_confidence DESC, sr_id) = 1), r AS (SELECT doc_id, pos, CASE WHEN regexp_matches(title, 'incident|reporting timeline|notification') THEN 'INCIDENT_MANAGEMENT' WHEN regexp_matches(title, 'transfer|subprocessor|data subject|dpa|processing agreement') THEN 'DATA_PROTECTION' WHEN contains(title, 'audit') THEN 'AUDIT_RIGHTS' WHEN contains(title, 'supply chain') THEN 'SECURITY_CONTROLS' WHEN framework = 'DORA' THEN 'REGULATORY_COMPLIANCE' WHEN framework = 'GDPR' THEN 'DATA_PROTECTION' END AS topic FROM m) SELECT s.doc_id, s.pos, CASE WHEN s.assessment = 'AMBIGUOUS_REQUIREMENT' THEN coalesce(r.topic, 'SECURITY_CONTROLS') ELSE s.topic END AS topic FROM scores s LEFT JOIN r USING (doc_id, pos) WHERE s.assessment <> 'VALID'")
def p23_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of findings, of ambiguous ones by the requirement that their best match names."""
    titles = F.create_map(*[F.lit(x) for r in demo.CATALOGUE for x in (r.sr_id, r.title)])
    found = Q._matches(spark, sf_dir).where("hits > 0").withColumn("topic", K.requirement_topic(F.element_at(titles, F.col("sr_id")), F.col("framework")))
    best = found.groupBy("doc_id", "pos").agg(F.min_by(F.struct("topic"), F.struct(-F.col("match_confidence"), "sr_id")).alias("m")).select("doc_id", "pos", "m.topic")
    rows = Q._assessed(spark, sf_dir).where("assessment <> 'VALID'").join(best, ["doc_id", "pos"], "left")
    return rows.select("doc_id", "pos", K.topic_of(F.col("assessment"), F.col("line"), F.col("topic")).alias("topic"))


@query(f"WITH {Q.SCORES}, {Q._CITED}, kinds AS (SELECT source, assessment AS finding_type, min(CASE WHEN risk_score >= 7 THEN 0 WHEN risk_score >= 4 THEN 1 ELSE 2 END) AS p, round(max(risk_score), 2) AS mx, round(sum(risk_score), 2) AS tot, count(*) AS n FROM scores WHERE assessment <> 'VALID' GROUP BY ALL), firsts AS (SELECT source, assessment AS finding_type, topic, min(struct_pack(d := doc_id, p := pos)) AS f FROM scores WHERE assessment <> 'VALID' AND topic IS NOT NULL GROUP BY ALL), spoken AS (SELECT source, finding_type, string_agg(topic, ', ' ORDER BY f, topic) AS ts FROM firsts GROUP BY ALL), plan AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, mx DESC, finding_type) AS no FROM kinds LEFT JOIN spoken USING (source, finding_type)), cited_rows AS (SELECT source, finding_type, string_agg('| ' || sr_id || ' | ' || framework || ' | ' || match_type || ' | ' || confidence || ' | ' || source_clause || ' |', chr(10) ORDER BY doc_id, pos, sr_id) AS t FROM evidence GROUP BY ALL), acts AS (SELECT source, no, chr(10) || '## ACT-' || printf('%03d', CAST(no AS INT)) || ' ' || finding_type || chr(10) || '- Priority: ' || ['HIGH', 'MEDIUM', 'LOW'][p + 1] || chr(10) || '- Highest score: ' || printf('%.2f', mx::DOUBLE) || ', sum: ' || printf('%.2f', tot::DOUBLE) || chr(10) || '- Clauses: ' || n || chr(10) || '- Topics: ' || coalesce(ts, '') || CASE WHEN t IS NULL THEN '' ELSE chr(10) || chr(10) || '| Requirement | Framework | Match | Confidence | First clause |' || chr(10) || '|---|---|---|---|---|' || chr(10) || t END AS a FROM plan LEFT JOIN cited_rows USING (source, finding_type)) SELECT source, '# Action plan: ' || source || chr(10) || string_agg(a, chr(10) ORDER BY no) AS text FROM acts GROUP BY source")
def s16_action_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown report of each source's actions with their evidence."""
    rows, matches = Q._stored_lines(spark, sf_dir)
    return RD.action_report(K.action_plan(rows, "source"), K.action_evidence(rows, matches, "source"), "source")


@query("WITH e AS (SELECT DISTINCT n_regionkey AS g, format('    {}[\"{}\"] -->|{}| {}[\"{}\"]', regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '_', 'g'), c_mktsegment, r_name, regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g'), n_name) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT g, 'graph LR' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS text FROM e GROUP BY g")
def s16_audit_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of edges for each group."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("n_regionkey", "g")
    return RD.audit_graph(rows, "g", "c_mktsegment", "n_name", "r_name")
