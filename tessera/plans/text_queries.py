"""Queries over document text: ingestion, obligations, classification, matching, retrieval, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking as CH
from tessera.operators import classify as C
from tessera.operators import compliance as K
from tessera.operators import matching as M
from tessera.operators import obligations as O  # noqa: E741
from tessera.operators import segments as S
from tessera.operators import store
from tessera.operators import tracing as T
from tessera.operators.shared import ordered_distinct, stored
from tessera.operators.vectors import InvertedFile
from tessera.plans import demo
from tessera.plans.registry import query, table, texts

LINES = "lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS pos FROM documents)"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hit(column: str, pattern: str, flags: str = "is") -> str:
    return f"regexp_matches({column}, {_lit(pattern)}, '{flags}')"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lines(texts(spark, sf_dir), "doc_id", "text", "source", "lang")


# ---- ingestion -------------------------------------------------------------


@query(f"WITH {LINES} SELECT doc_id, pos, CAST(length(line) AS INT) AS n_chars, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_char, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) AS BIGINT) AS end_char FROM lines")
def s01_line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.offsets(_lines(spark, sf_dir), "doc_id", "pos", "line")
    return rows.select("doc_id", "pos", F.length("line").alias("n_chars"), F.col("begin").cast("long").alias("begin_char"), F.col("end").cast("long").alias("end_char"))


@query("SELECT page_id, CAST(strlen(html) AS INT) AS n_bytes, sha256(html) AS sha256, CASE WHEN html[1:4] = '%PDF' THEN 'pdf' WHEN html[1:2] = 'PK' THEN 'docx' ELSE 'txt' END AS kind, strlen(html) <= 52428800 AS accepted FROM pages")
def s05_sniff_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.files import sniff

    raw = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return sniff(raw).select("page_id", F.col("n_bytes").cast("int").alias("n_bytes"), "sha256", "kind", "accepted")


_TRIM = "trim(line, ' ')"
_WORDS = f"list_filter(regexp_split_to_array(regexp_replace({_TRIM}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 2)"
_KIND = f"""CASE WHEN length({_TRIM}) < 4 OR regexp_matches({_TRIM}, '^\\s*[-–—]?\\s*\\d{{1,3}}\\s*[-–—]?\\s*$') OR regexp_matches({_TRIM}, '^(?:confidential|draft|version|revision|prepared\\s+by|date:|document\\s+id|page\\s+\\d|copyright|©|proprietary)[\\s:—\\-]*', 'i') THEN 'skip'
 WHEN regexp_matches({_TRIM}, '^(?:table\\s+of\\s+contents?|contents?|index|inhaltsverzeichnis)\\s*$', 'i') OR regexp_matches({_TRIM}, '^.{{3,}}(?:\\.{{3,}}\\s*\\d{{1,3}}|\\s{{3,}}\\d{{1,3}}|\\t\\d{{1,3}})\\s*$') THEN 'toc'
 WHEN regexp_matches({_TRIM}, '^\\s*(?:(?:\\d{{1,2}}\\.){{1,4}}\\d{{0,2}}|[IVXLCDM]{{1,6}}\\.)\\s{{1,4}}[A-ZÜÄÖÑ"]') AND length({_TRIM}) <= 200 THEN 'heading'
 WHEN length({_TRIM}) <= 200 AND len({_WORDS}) BETWEEN 1 AND 12 AND len(list_filter({_WORDS}, lambda w: w = upper(w) AND w <> lower(w))) >= 0.7 * len({_WORDS}) THEN 'heading'
 WHEN regexp_matches({_TRIM}, '^[^:\\n\\r]{{5,100}}:\\s*$') THEN 'heading_colon' ELSE 'body' END"""


@query(f"WITH {LINES} SELECT lang, {_KIND} AS kind, count(*) AS n_blocks FROM lines GROUP BY ALL")
def p01_block_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("lang", S.block_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n_blocks"))


_ROWS = "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')"
_PIPES = f"len(list_filter({_ROWS}, lambda x: contains(x, '|')))"
_BULLETS = f"len(list_filter({_ROWS}, lambda x: regexp_matches(x, '^\\s*(?:[•·▪▸►‣◦\\-–—*]|\\d+[.)]\\s)\\s+\\S')))"
_TABS = f"len(list_filter({_ROWS}, lambda x: regexp_matches(x, '\\t|  {{3,}}')))"


@query(f"SELECT doc_id, CASE WHEN len({_ROWS}) = 0 THEN 'paragraph' WHEN {_PIPES} >= 2 AND {_PIPES} >= 0.35 * len({_ROWS}) THEN 'table' WHEN len({_ROWS}) >= 3 AND {_TABS} >= 0.6 * len({_ROWS}) THEN 'table' WHEN {_BULLETS} >= 2 AND {_BULLETS} >= 0.3 * len({_ROWS}) THEN 'bullet_list' WHEN len({_ROWS}) >= 2 AND regexp_matches({_ROWS}[1], '^[^:\\n\\r]{{5,100}}:\\s*$') AND len(list_filter({_ROWS}[2:], lambda x: regexp_matches(x, '^\\s*(?:[•·▪▸►‣◦\\-–—*]|\\d+[.)]\\s)\\s+\\S'))) >= 0.5 * (len({_ROWS}) - 1) THEN 'bullet_list' ELSE 'paragraph' END AS layout FROM documents")
def p05_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", S.layout(F.col("text")).alias("layout"))


def _strength_sql() -> str:
    tests = " ".join(f"WHEN regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])({p})([^\\p{{L}}\\p{{N}}_]|$)', 'i') THEN {s}::DOUBLE" for s, p in demo.STRENGTHS)
    labels = " ".join(f"WHEN strength >= {s} THEN '{label}'" for s, label in T.LANGUAGE_LABELS)
    return f"WITH s AS (SELECT doc_id, CASE {tests} ELSE 0.1::DOUBLE END AS strength FROM documents) SELECT doc_id, strength, CASE {labels} ELSE 'none detected' END AS label FROM s"


@query(_strength_sql())
def p08_language_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graded test with words of the supplied prose; the English and German list is the operator's default."""
    rows = texts(spark, sf_dir).select("doc_id", S.language_strength(F.col("text"), demo.STRENGTHS).alias("strength"))
    return rows.select("doc_id", "strength", T.language_label(F.col("strength")).alias("label"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '…' ELSE text END AS preview, CAST(length(regexp_replace(lower(replace(replace(text, '-', ' '), '_', ' ')), '\\s+', ' ', 'g')) AS INT) AS n_normal, replace(lower(replace(replace(text, '-', ' '), '_', ' ')), chr(10), ' ')[1:60] AS head FROM documents")
def p27_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.col("text"), C.normalised(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", F.when(F.length(t) > 200, F.concat(F.substring(t, 1, 200), F.lit("…"))).otherwise(t).alias("preview"), F.length(F.regexp_replace(n, r"\s+", " ")).alias("n_normal"), F.substring(F.replace(n, F.lit("\n"), F.lit(" ")), 1, 60).alias("head"))


@query("WITH x AS (SELECT *, CASE WHEN role = 'user' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS b FROM conversations), y AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM x) SELECT conv_id, CAST(seg AS BIGINT) AS seg, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, printf('CL-%03d', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY seg) AS INT)) AS id FROM y GROUP BY conv_id, seg")
def w06_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.segments(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    out = rows.groupBy("conv_id", "seg").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n_rows"), F.sum(F.length("text")).cast("long").alias("n_chars"))
    return store.number(out, "CL-", F.col("seg"), partition=["conv_id"])


@query(f"WITH {LINES}, m AS (SELECT *, length(line) < 60 AS o FROM lines), r AS (SELECT *, sum(CASE WHEN o THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run, lead(1) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run, o ORDER BY pos) AS k FROM r) SELECT doc_id, pos, o AND k % 2 = 1 AND nx IS NOT NULL AS merge_with_next FROM p")
def w08_pair_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pair_orphans(_lines(spark, sf_dir), "doc_id", "pos", F.length("line") < 60).select("doc_id", "pos", "merge_with_next")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations")
def w12_section_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_heading(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("text"))).select("conv_id", "turn", "section")


@query(f"WITH {LINES}, e AS (SELECT *, lag(regexp_matches(line, '[.!?:;]\\s*$')) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM lines), s AS (SELECT *, sum(CASE WHEN coalesce(e, TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM e) SELECT doc_id, CAST(seg AS BIGINT) AS seg, string_agg(line, ' ' ORDER BY pos) AS text FROM s GROUP BY doc_id, seg")
def w13_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reflow(_lines(spark, sf_dir), "doc_id", "pos", "line")


def _chunks_sql(target: int = 400, most: int = 512, overlap: int = 50) -> str:
    words = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
    said = f"string_split(regexp_replace(text, {_lit(CH.SENTENCE)}, '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    back = f"CASE WHEN p[e + 1] <= {overlap} THEN 0 ELSE least(e, list_filter(range(0, n), lambda k: p[k + 1] >= p[e + 1] - {overlap})[1] + 1) END"
    base = lambda at: f"CASE WHEN {at} = 0 THEN 0 ELSE p[{at}] END"
    return f"""WITH RECURSIVE {LINES}, base AS (SELECT doc_id, pos, line AS text, len({words("line")}) AS t FROM lines),
said AS (SELECT doc_id, pos, unnest({said}) AS text, generate_subscripts({said}, 1) AS s FROM base WHERE t > {most}),
counted AS (SELECT *, {words("text")} AS w FROM said),
cut AS (SELECT doc_id, pos, s, unnest(range(0, (len(w) - 1) // {most} + 1)) AS part, w FROM counted WHERE len(w) > {most}),
units AS (SELECT doc_id, pos, 0 AS s, 0 AS part, text, t FROM base WHERE t BETWEEN 1 AND {most} UNION ALL SELECT doc_id, pos, s, 0, text, len(w) FROM counted WHERE len(w) BETWEEN 1 AND {most} UNION ALL SELECT doc_id, pos, s, part, array_to_string(w[part * {most} + 1 : (part + 1) * {most}], ' '), least({most}, len(w) - part * {most}) FROM cut),
sums AS (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY pos, s, part) AS p FROM units),
docs AS (SELECT doc_id, list(text ORDER BY pos, s, part) AS texts, list(pos ORDER BY pos, s, part) AS places, list(CAST(p AS BIGINT) ORDER BY pos, s, part) AS p, count(*) AS n FROM sums GROUP BY doc_id),
walk AS (SELECT doc_id, 0 AS chunk, 0::BIGINT AS begin, ends(p, n, 0, -1) AS e FROM docs UNION ALL SELECT doc_id, chunk + 1, s, ends(p, n, s, e) FROM (SELECT *, CASE WHEN p[e + 2] - ({base("b")}) <= {most} THEN b ELSE e + 1 END AS s FROM (SELECT w.*, p, n, {back} AS b FROM walk w JOIN docs USING (doc_id) WHERE e < n - 1)))
SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(places[begin + 1] AS INT) AS first_pos, CAST(places[e + 1] AS INT) AS last_pos, CAST(p[e + 1] - ({base("begin")}) AS BIGINT) AS n_tokens, array_to_string(texts[begin + 1 : e + 1], chr(10)) AS text FROM walk JOIN docs USING (doc_id)"""


def _chunk_end_sql(sql: str, target: int = 400, most: int = 512) -> str:
    """``ends(p, n, s, e)`` written out: the end of the chunk that begins at s behind one that ends at e."""
    for s, e in (("0", "-1"), ("s", "e")):
        base = f"CASE WHEN {s} = 0 THEN 0 ELSE p[{s}] END" if s != "0" else "0"
        over = f"list_filter(range(0, n), lambda k: p[k + 1] > {base} + {target})[1]"
        end = f"CASE WHEN {over} IS NULL THEN n - 1 WHEN p[{over} + 1] - {base} <= {most} OR {over} <= {e} + 1 THEN greatest({over}, {e} + 1) ELSE {over} - 1 END"
        sql = sql.replace(f"ends(p, n, {s}, {e})", end)
    return sql


@query(_chunk_end_sql(_chunks_sql()))
def w11_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in chunks of 400 to 512 words with 50 of overlap; longer lines by sentences."""
    return CH.chunks(_lines(spark, sf_dir), "doc_id", "pos", "line")


@query()
def w11_subword_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the tokens of a public byte-level vocabulary; checked against a loop in the tests."""
    import public_tokenizers

    return CH.chunks(_lines(spark, sf_dir), "doc_id", "pos", "line", tokens=CH.Subwords(public_tokenizers.path("byte_bpe_50k.json")))


# ---- obligations -----------------------------------------------------------


def _assess_sql() -> str:
    cases, n = [], 0
    severe = f"CASE WHEN {_hit('line', demo.OBLIGATIONS.escalate)} THEN 'HIGH' ELSE 'MEDIUM' END"
    out = {"assessment": [], "severity": [], "rule": []}
    for g in demo.OBLIGATIONS.groups:
        for p in g.patterns:
            test = f"WHEN {_hit('line', p)} THEN "
            out["assessment"].append(test + _lit(g.assessment))
            out["severity"].append(test + (_lit(g.severity) if g.severity else severe))
            out["rule"].append(test + str(n))
            n += 1
    cases = [f"CASE {' '.join(v)} {'ELSE ' + e if e else ''} END AS {k}" for (k, v), e in zip(out.items(), ("'VALID'", "'LOW'", ""))]
    return f"{LINES}, assessed AS (SELECT doc_id, source, lang, pos, line, {', '.join(cases)} FROM lines)"


ASSESSED = _assess_sql()


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.assess(_lines(spark, sf_dir), text="line", pack=demo.OBLIGATIONS)


@query(f"WITH {ASSESSED} SELECT doc_id, pos, assessment, severity, rule, CASE WHEN rule IS NULL THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM assessed")
def p10_rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select("doc_id", "pos", "assessment", "severity", "rule", F.col("confidence").cast("double").alias("confidence"))


@query(f"WITH {ASSESSED} SELECT lang, assessment, count(*) AS n_clauses, count(*) FILTER (assessment <> 'VALID') AS n_flagged, count(*) FILTER (severity = 'HIGH') AS n_high FROM assessed GROUP BY ALL")
def a05_obligation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.histogram(_assessed(spark, sf_dir), "lang")


@query(f"WITH {ASSESSED}, m AS (SELECT a.doc_id, a.pos, a.assessment, a.severity, CAST(l.quality AS DOUBLE) * 0.9 AS c, CASE WHEN l.toxic = 1 THEN 'OPERATIONAL_RISK' ELSE a.assessment END AS ma, CASE WHEN l.toxic = 1 THEN 'HIGH' ELSE a.severity END AS ms FROM assessed a LEFT JOIN labels l USING (doc_id)), f AS (SELECT *, CASE WHEN c >= 0.75 THEN ma ELSE assessment END AS fa, CASE WHEN c >= 0.75 THEN ms ELSE severity END AS fs FROM m) SELECT doc_id, pos, fa AS assessment, fs AS severity, CASE WHEN c >= 0.75 THEN 'llm' ELSE 'rule_based' END AS source, CASE WHEN c IS NULL THEN NULL WHEN fa = assessment AND fs = severity THEN 'no_change' WHEN (CASE fs WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) > (CASE severity WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) THEN 'ai_upgrade' WHEN (CASE fs WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) < (CASE severity WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) THEN 'ai_downgrade' ELSE 'ai_override' END AS delta, CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.6 THEN 'medium' WHEN c IS NOT NULL THEN 'low' END AS bucket, CASE WHEN coalesce(c < 0.6, FALSE) OR fs = 'HIGH' OR fa IN ('NON_TRANSFERABLE_REGULATION', 'OPERATIONAL_RISK') THEN 'HIGH' WHEN coalesce(c < 0.85, FALSE) OR fa IN ('AMBIGUOUS_REQUIREMENT', 'SCOPE_UNDEFINED') THEN 'MEDIUM' ELSE 'LOW' END AS review FROM f")
def p22_merge_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand in for a model's results."""
    rules = _assessed(spark, sf_dir).select("doc_id", "pos", "assessment", "severity", F.col("assessment").alias("a0"), F.col("severity").alias("s0"))
    toxic = F.col("toxic") == 1
    model = rules.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "pos", F.when(toxic, "OPERATIONAL_RISK").otherwise(F.col("assessment")).alias("assessment"), F.when(toxic, "HIGH").otherwise(F.col("severity")).alias("severity"), (F.col("quality").cast("double") * 0.9).alias("model_confidence"))
    out = O.merge_model(rules, model, ["doc_id", "pos"], ["assessment", "severity"])
    bucket, c = O.confidence_bucket(F.col("model_confidence")), F.col("model_confidence")
    from tessera.packs import SEVERITY_RANK

    delta = O.severity_delta(SEVERITY_RANK, F.col("s0"), F.col("severity"), F.col("a0") == F.col("assessment"), c.isNotNull())
    return out.select("doc_id", "pos", "assessment", "severity", "source", delta.alias("delta"), bucket.alias("bucket"), O.review_priority(F.col("assessment"), F.col("severity"), bucket).alias("review"))


# ---- classification --------------------------------------------------------


def _classify_sql() -> str:
    n = "replace(replace(lower(text), '-', ' '), '_', ' ')"
    hits = lambda ks: " + ".join(f"CAST(contains({n}, {_lit(k)}) AS INT)" for k in ks)
    cols = [f"{hits(k)} AS t{i}" for i, k in enumerate(demo.TYPES.values())] + [f"{hits(k)} AS s{i}" for i, k in enumerate(demo.LEVELS.values())]
    top, total = f"greatest({', '.join(f't{i}' for i in range(len(demo.TYPES)))})", " + ".join(f"t{i}" for i in range(len(demo.TYPES)))
    kind = " ".join(f"WHEN t{i} = {top} THEN {_lit(t)}" for i, t in enumerate(demo.TYPES))
    level = " ".join(f"WHEN s{i} > 0 THEN {_lit(t)}" for i, t in enumerate(demo.LEVELS))
    return f"""WITH h AS (SELECT doc_id, {', '.join(cols)} FROM documents), c AS (SELECT doc_id, CASE WHEN {total} = 0 THEN 'OTHER' {kind} END AS contract_type, {top} AS type_hits, {total} AS total_hits, CASE WHEN {total} = 0 THEN 0.5 ELSE round(least(0.45::DOUBLE + ({top})::DOUBLE / ({total}) * 0.5::DOUBLE + least(({top}) * 0.03::DOUBLE, 0.2::DOUBLE), 0.95::DOUBLE), 2) END AS confidence, CASE {level} ELSE 'INTERNAL' END AS data_sensitivity FROM h)
 SELECT doc_id, contract_type, CAST(type_hits AS INT) AS type_hits, CAST(total_hits AS INT) AS total_hits, CAST(confidence AS DOUBLE) AS confidence, data_sensitivity, CASE WHEN data_sensitivity IN ('PERSONAL_DATA', 'SPECIAL_CATEGORY') OR contract_type IN ('CLOUD_HOSTING', 'ICT_OUTSOURCING') THEN 'CRITICAL' WHEN contract_type IN ('DATA_PROCESSING', 'MSP') THEN 'HIGH' WHEN contract_type = 'SAAS' THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM c"""


@query(_classify_sql())
def a01_keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01, P11, P12."""
    out = C.classify(texts(spark, sf_dir), types=demo.TYPES, levels=demo.LEVELS)
    return out.select("doc_id", "contract_type", "type_hits", "total_hits", F.col("confidence").cast("double").alias("confidence"), "data_sensitivity", C.vendor_tier(F.col("contract_type"), F.col("data_sensitivity")).alias("tier"))


# ---- matching --------------------------------------------------------------


def _match_sql() -> str:
    parts = []
    for r in demo.CATALOGUE:
        hits = " + ".join(f"CAST({_hit('line', p, 'i')} AS INT)" for p in r.patterns)
        parts.append(f"SELECT doc_id, source, lang, pos, line, {_lit(r.sr_id)} AS sr_id, {_lit(r.framework)} AS framework, {_lit(r.title)} AS title, {hits} AS hits, {len(r.patterns)} AS n FROM lines")
    return f"{LINES}, hit AS ({' UNION ALL '.join(parts)}), matches AS (SELECT doc_id, source, lang, pos, sr_id, framework, title, hits, CASE WHEN hits >= 2 THEN 'DIRECT_MATCH' WHEN hits = 1 THEN 'PARTIAL_MATCH' ELSE 'NO_MATCH' END AS match_type, CAST(CASE WHEN hits >= 2 THEN round(0.82::DOUBLE + least(hits::DOUBLE / n * 0.13::DOUBLE, 0.13::DOUBLE), 2) WHEN hits = 1 THEN round(0.62::DOUBLE + hits::DOUBLE / n * 0.16::DOUBLE, 2) ELSE 0 END AS DOUBLE) AS match_confidence FROM hit)"


MATCHES = _match_sql()


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_patterns(_lines(spark, sf_dir), demo.CATALOGUE, text="line", keys=["doc_id", "source", "lang", "pos"])


@query(f"WITH {MATCHES} SELECT doc_id, pos, sr_id, CAST(hits AS INT) AS hits, match_type, match_confidence FROM matches WHERE hits > 0")
def j10_pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 as one scan of literal patterns, P14, P32."""
    return _matches(spark, sf_dir).where("hits > 0").select("doc_id", "pos", "sr_id", "hits", "match_type", F.col("match_confidence").cast("double").alias("match_confidence"))


@query(f"WITH {MATCHES} SELECT doc_id, sr_id, CAST(sum(hits) AS BIGINT) AS hits FROM matches WHERE hits > 0 GROUP BY ALL")
def j10_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches by a join with a pattern table, through the literals that patterns need."""
    patterns = spark.createDataFrame([(r.sr_id, r.framework, "(?iu)" + p) for r in demo.CATALOGUE for p in r.patterns], "sr_id string, framework string, pattern string")
    out = M.match_patterns_join(_lines(spark, sf_dir), patterns, text="line", keys=["doc_id", "pos"])
    return out.groupBy("doc_id", "sr_id").agg(F.sum("hits").cast("long").alias("hits"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, 'attion', 'i') THEN trim(replace(text[greatest(strpos(lower(text), 'attion') - 50, 1):strpos(lower(text), 'attion') + 105], chr(10), ' '), ' ') ELSE '' END AS evidence FROM documents")
def p15_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", M.evidence(F.col("text"), ("attion",)).alias("evidence"))


COMPLIANCE = f"{MATCHES}, compliance AS (SELECT source, framework, sr_id, count(*) FILTER (match_type = 'DIRECT_MATCH') AS n_direct, count(*) FILTER (match_type = 'PARTIAL_MATCH') AS n_partial, max(match_confidence) AS confidence, arg_min(doc_id, struct_pack(a := -match_confidence, b := doc_id)) AS bc, CASE WHEN bool_or(match_type = 'DIRECT_MATCH') THEN 'COMPLIANT' WHEN bool_or(match_type = 'PARTIAL_MATCH') THEN 'WEAK_MATCH' ELSE 'MISSING' END AS result FROM matches GROUP BY source, framework, sr_id), findings AS (SELECT source, framework, sr_id, n_direct, n_partial, confidence, CASE WHEN n_direct + n_partial > 0 THEN bc END AS best_clause, result, CASE result WHEN 'MISSING' THEN 'HIGH' WHEN 'WEAK_MATCH' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM compliance)"


def _compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.compliance(_matches(spark, sf_dir), "source", clause="doc_id")


@query(f"WITH {COMPLIANCE} SELECT * FROM findings")
def a02_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compliance(spark, sf_dir).select("source", "framework", "sr_id", "n_direct", "n_partial", F.col("confidence").cast("double").alias("confidence"), "best_clause", "result", "severity")


@query(f"WITH {COMPLIANCE} SELECT source, framework, count(*) AS total, count(*) FILTER (result = 'COMPLIANT') AS compliant, count(*) FILTER (result = 'WEAK_MATCH') AS weak, count(*) FILTER (result = 'MISSING') AS missing, CAST(round((count(*) FILTER (result = 'COMPLIANT') + count(*) FILTER (result = 'WEAK_MATCH'))::DOUBLE / count(*) * 100, 1) AS DOUBLE) AS coverage_percent FROM findings GROUP BY ALL")
def a03_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.coverage(_compliance(spark, sf_dir), "source")


@query(f"WITH {COMPLIANCE} SELECT source, CASE max(CASE severity WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) WHEN 2 THEN 'HIGH_RISK' WHEN 1 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS status, count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium, count(*) FILTER (severity = 'LOW') AS n_low, count(*) AS n_findings FROM findings GROUP BY ALL")
def a06_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A04, A06."""
    return K.overall(_compliance(spark, sf_dir), "source")


@query(f"WITH {COMPLIANCE}, k AS (SELECT *, CASE WHEN severity = 'HIGH' AND result = 'MISSING' THEN 'REJECT' WHEN severity = 'MEDIUM' OR (severity = 'HIGH' AND result = 'WEAK_MATCH') THEN 'CONDITIONAL' ELSE 'APPROVE' END AS c FROM findings) SELECT source, CASE WHEN bool_or(c = 'REJECT') THEN 'REJECT' WHEN bool_or(c = 'CONDITIONAL') THEN 'CONDITIONAL_APPROVAL' ELSE 'APPROVE' END AS decision, count(*) FILTER (c <> 'APPROVE') AS n_blocking, count(*) AS n_findings FROM k GROUP BY ALL")
def a07_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A07, P25 by the adapter from compliance results to decisions."""
    return K.decision(_compliance(spark, sf_dir).withColumn("finding_type", F.col("result")), "source")


@query(f"WITH {COMPLIANCE}, t AS (SELECT *, CASE WHEN severity = 'LOW' THEN NULL ELSE CASE framework || ' ' || result WHEN 'DORA MISSING' THEN 'Legal' WHEN 'DORA WEAK_MATCH' THEN 'Security' WHEN 'NIS2 MISSING' THEN 'Security' WHEN 'NIS2 WEAK_MATCH' THEN 'Security' WHEN 'GDPR MISSING' THEN 'DPO' WHEN 'GDPR WEAK_MATCH' THEN 'DPO' WHEN 'ISO27001 MISSING' THEN 'Security' WHEN 'ISO27001 WEAK_MATCH' THEN 'Security' ELSE 'Legal' END END AS owner FROM findings) SELECT source, sr_id, owner, printf('TASK-%03d', CAST(row_number() OVER (PARTITION BY source ORDER BY sr_id) AS INT)) AS id FROM t WHERE owner IS NOT NULL")
def w05_task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remediation tasks with owners, numbered after filtering."""
    rows = _compliance(spark, sf_dir).where("severity <> 'LOW'").select("source", "sr_id", K.owner(F.col("framework"), F.col("result")).alias("owner"))
    return store.number(rows, "TASK-", F.col("sr_id"), partition=["source"])


@query(f"WITH {MATCHES} SELECT sr_id, count(*) FILTER (match_type = 'DIRECT_MATCH') AS n_direct, count(*) FILTER (match_type = 'PARTIAL_MATCH') AS n_partial, count(*) FILTER (match_type = 'NO_MATCH') AS n_none, CAST(round(avg(match_confidence) FILTER (hits > 0), 4) AS DOUBLE) AS avg_confidence FROM matches GROUP BY ALL")
def a15_match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t: F.count_if(F.col("match_type") == t)
    return _matches(spark, sf_dir).groupBy("sr_id").agg(n("DIRECT_MATCH").alias("n_direct"), n("PARTIAL_MATCH").alias("n_partial"), n("NO_MATCH").alias("n_none"), F.round(F.avg(F.when(F.col("hits") > 0, F.col("match_confidence"))), 4).alias("avg_confidence"))


# ---- retrieval and evaluation ----------------------------------------------

TOKENS = "toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS tok FROM documents), d AS (SELECT * FROM toks WHERE regexp_matches(tok, '^[a-z]{2,}$')), btoks AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS tok FROM benchmark), b AS (SELECT * FROM btoks WHERE regexp_matches(tok, '^[a-z]{2,}$'))"
IDF = f"{TOKENS}, idf AS (SELECT tok, count(DISTINCT item_id) AS df, ln(((SELECT count(*) FROM benchmark) + 1)::DOUBLE / (count(DISTINCT item_id) + 1)) + 1 AS idf FROM b GROUP BY tok)"


def _weights_sql(name: str, source: str, key: str) -> str:
    return f"{name}_raw AS (SELECT {key}, tok, count(*)::DOUBLE / any_value(n) * any_value(idf) AS x FROM (SELECT s.{key}, s.tok, i.idf, z.n FROM {source} s JOIN idf i USING (tok) JOIN (SELECT {key}, count(*) AS n FROM {source} GROUP BY {key}) z USING ({key})) GROUP BY {key}, tok), {name} AS (SELECT {key}, tok, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS w FROM {name}_raw)"


SIMILAR = f"{IDF}, {_weights_sql('dw', 'd', 'doc_id')}, {_weights_sql('bw', 'b', 'item_id')}, score AS (SELECT doc_id, item_id, round(sum(dw.w * bw.w), 4) AS score FROM dw JOIN bw USING (tok) GROUP BY doc_id, item_id), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id DESC) AS INT) AS rank FROM score WHERE score >= 0.15 QUALIFY rank <= 5)"


def _token_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, items = texts(spark, sf_dir), table(spark, sf_dir, "benchmark")
    d, b = M.token_rows(docs, "text", "doc_id", stop_words=()), M.token_rows(items, "text", "item_id", stop_words=())
    return d, b, M.idf(b, "item_id", items.count())


@query(f"WITH {IDF} SELECT tok, df, CAST(round(idf, 6) AS DOUBLE) AS idf FROM idf")
def a16_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_tables(spark, sf_dir)[2].select("tok", "df", F.round("idf", 6).alias("idf"))


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, b, i = _token_tables(spark, sf_dir)
    i = stored(i, "idf")
    return M.top_similar(M.text_weights(texts(spark, sf_dir), "text", "doc_id", i), M.weights(b, "item_id", i), "doc_id", "item_id")


@query(f"WITH {SIMILAR} SELECT doc_id, item_id, score, rank FROM top")
def j11_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, J11, W03."""
    return _similar(spark, sf_dir).select("doc_id", "item_id", "score", "rank")


_EXACT = "x AS (SELECT d.doc_id, i.item_id FROM documents d JOIN benchmark i ON i.text <> '' AND contains(lower(d.text), lower(i.text)))"


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.contained(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query(f"WITH {SIMILAR}, {_EXACT}, u AS (SELECT coalesce(x.doc_id, t.doc_id) AS doc_id, coalesce(x.item_id, t.item_id) AS item_id, x.doc_id IS NOT NULL AS det, t.score FROM x FULL JOIN top t ON x.doc_id = t.doc_id AND x.item_id = t.item_id), r AS (SELECT *, count(*) FILTER (det) OVER (PARTITION BY doc_id) AS nd, row_number() OVER (PARTITION BY doc_id, det ORDER BY score DESC NULLS LAST, item_id DESC) AS rk FROM u) SELECT doc_id, item_id, det, score FROM r WHERE det OR rk <= greatest(0, 3 - nd)")
def w04_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items first, filled up to three by similarity."""
    return M.shortlist(_exact(spark, sf_dir), _similar(spark, sf_dir), "doc_id", "item_id", cap=3)


@query(f"WITH {SIMILAR}, {_EXACT}, f AS (SELECT t.doc_id IS NOT NULL AS p, x.doc_id IS NOT NULL AS e FROM x FULL JOIN top t ON x.doc_id = t.doc_id AND x.item_id = t.item_id), s AS (SELECT count(*) FILTER (p AND e) AS tp, count(*) FILTER (p AND NOT e) AS fp, count(*) FILTER (e AND NOT p) AS fn FROM f) SELECT tp, fp, fn, CAST(round(tp::DOUBLE / nullif(tp + fp, 0), 4) AS DOUBLE) AS precision, CAST(round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS DOUBLE) AS recall, CAST(round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 4) AS DOUBLE) AS f1 FROM s")
def j20_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20, A18, A19, U02."""
    return M.evaluate(_similar(spark, sf_dir).withColumn("match_type", F.lit("x")), _exact(spark, sf_dir).withColumn("match_type", F.lit("x")), ["doc_id", "item_id"])


@query()
def j12_inverted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every twentieth vector among all by the index; its recall is tested against brute force."""
    rows = table(spark, sf_dir, "embeddings")
    index = InvertedFile.build(rows, key="vec_id", vector="embedding")
    return index.search(rows.where("vec_id % 20 = 0"), key="vec_id", vector="embedding")


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 20 = 0), l AS (SELECT vec_id AS item_id, embedding AS b FROM embeddings), s AS (SELECT query_id, item_id, round(list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])), 4) AS similarity FROM q, l) SELECT query_id, item_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, item_id) AS INT) AS rank FROM s QUALIFY rank <= 10")
def j12_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors, top 10 by cosine."""
    e = table(spark, sf_dir, "embeddings")
    return M.nearest(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")))


# ---- risk chain ------------------------------------------------------------

TOPICS = f"{ASSESSED}, topics AS (SELECT *, CASE assessment WHEN 'NON_TRANSFERABLE_REGULATION' THEN 'REGULATORY_COMPLIANCE' WHEN 'CUSTOMER_RESPONSIBILITY' THEN 'DATA_PROTECTION' WHEN 'SCOPE_UNDEFINED' THEN CASE WHEN regexp_matches(lower(line), 'law|regulation|directive|statutory|supervisory') THEN 'REGULATORY_COMPLIANCE' ELSE 'SECURITY_CONTROLS' END WHEN 'OPERATIONAL_RISK' THEN CASE WHEN regexp_matches(lower(line), 'audit|source code|unrestricted access|access to all|unlimited') THEN 'AUDIT_RIGHTS' WHEN regexp_matches(lower(line), 'sla|uptime|availability|service credit') THEN 'SERVICE_LEVELS' ELSE 'INCIDENT_MANAGEMENT' END WHEN 'AMBIGUOUS_REQUIREMENT' THEN 'SECURITY_CONTROLS' END AS topic FROM assessed)"
_MATCH_BODY = MATCHES.split(", hit AS (", 1)[1]
SCORES = f"{TOPICS}, hit AS ({_MATCH_BODY}, per AS (SELECT doc_id, pos, least(sum(CASE match_type WHEN 'DIRECT_MATCH' THEN 1.5::DOUBLE ELSE 0.75::DOUBLE END), 2.0::DOUBLE) AS bonus, max(match_confidence) AS best FROM matches WHERE hits > 0 GROUP BY doc_id, pos), base AS (SELECT t.*, p.bonus, p.best, CASE severity WHEN 'HIGH' THEN 7.0::DOUBLE WHEN 'MEDIUM' THEN 4.0::DOUBLE ELSE 1.5::DOUBLE END + CASE topic WHEN 'REGULATORY_COMPLIANCE' THEN 1.5::DOUBLE WHEN 'DATA_PROTECTION' THEN 1.5::DOUBLE WHEN 'SECURITY_CONTROLS' THEN 1.0::DOUBLE WHEN 'AUDIT_RIGHTS' THEN 1.0::DOUBLE WHEN 'INCIDENT_MANAGEMENT' THEN 0.5::DOUBLE WHEN 'SERVICE_LEVELS' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS bt FROM topics t LEFT JOIN per p USING (doc_id, pos)), r1 AS (SELECT *, CASE WHEN assessment = 'AMBIGUOUS_REQUIREMENT' THEN greatest(bt, coalesce(best, 0) * 10) ELSE bt + coalesce(bonus, 0) END AS r FROM base), r2 AS (SELECT *, CASE WHEN severity = 'HIGH' THEN greatest(r, 7.0::DOUBLE) ELSE r END AS rr FROM r1), scores AS (SELECT *, round(greatest(1.0::DOUBLE, least(10.0::DOUBLE, CASE WHEN best IS NULL AND assessment <> 'VALID' THEN greatest(rr, 6.0::DOUBLE) ELSE rr END)), 2) AS risk_score FROM r2)"
_PRI = "CASE WHEN {0} >= 7 THEN 'HIGH' WHEN {0} >= 4 THEN 'MEDIUM' ELSE 'LOW' END"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assessed(spark, sf_dir)
    topic = F.when(F.col("assessment") != "VALID", K.topic_of(F.col("assessment"), F.col("line"), F.lit(None).cast("string")))
    return K.clause_scores_of(rows.withColumn("topic", topic), demo.CATALOGUE, text="line")


@query(f"WITH {SCORES} SELECT doc_id, pos, assessment, severity, topic, CAST(risk_score AS DOUBLE) AS risk_score, {_PRI.format('risk_score')} AS priority FROM scores")
def p26_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P23, P26, A14, J01."""
    return _scores(spark, sf_dir).select("doc_id", "pos", "assessment", "severity", "topic", F.col("risk_score").cast("double").alias("risk_score"), "priority")


@query(f"WITH {SCORES} SELECT source, coalesce(topic, 'VALID') AS topic, count(*) AS n_clauses, CAST(max(risk_score) AS DOUBLE) AS max_score, CAST(round(avg(risk_score), 4) AS DOUBLE) AS avg_score, CAST(round(sum(risk_score), 2) AS DOUBLE) AS total_score, {_PRI.format('max(risk_score)')} AS priority FROM scores GROUP BY ALL")
def a10_topic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.topic_summary(_scores(spark, sf_dir), "source")


PLAN = f"{SCORES}, plan AS (SELECT source, assessment AS finding_type, min(CASE WHEN risk_score >= 7 THEN 0 WHEN risk_score >= 4 THEN 1 ELSE 2 END) AS p, round(max(risk_score), 2) AS max_score, round(sum(risk_score), 2) AS total_score, count(*) AS n_findings, list_sort(list_distinct(list(doc_id))) AS docs, list_sort(list_distinct(list(topic))) AS topics FROM scores WHERE assessment <> 'VALID' GROUP BY ALL)"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).where("assessment <> 'VALID'").withColumnRenamed("assessment", "finding_type").withColumn("position", F.struct("doc_id", "pos"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.action_plan(_rated(spark, sf_dir), "source", item="doc_id")


@query(f"WITH {PLAN} SELECT source, finding_type, ['HIGH', 'MEDIUM', 'LOW'][p + 1] AS priority, CAST(max_score AS DOUBLE) AS max_score, CAST(total_score AS DOUBLE) AS total_score, n_findings, CAST(len(docs) AS INT) AS n_docs, array_to_string(topics, ',') AS topics, printf('%d', docs[1]) AS first_doc, CAST(row_number() OVER (PARTITION BY source ORDER BY p, max_score DESC, finding_type) AS INT) AS action_no FROM plan")
def a12_action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, O04, J05."""
    return _plan(spark, sf_dir).select("source", "finding_type", "priority", "max_score", "total_score", "n_findings", F.col("n_clauses").cast("int").alias("n_docs"), F.array_join(F.array_sort("topics"), ",").alias("topics"), F.col("first_clause").cast("string").alias("first_doc"), "action_no")


EXPOSURE = f"WITH {PLAN}, ev AS (SELECT DISTINCT s.source, s.assessment AS finding_type, m.sr_id FROM scores s JOIN matches m USING (doc_id, pos) WHERE s.assessment <> 'VALID' AND m.hits > 0), x AS (SELECT e.sr_id, e.source || '/' || e.finding_type AS a, unnest(p.docs) AS doc_id FROM ev e JOIN plan p USING (source, finding_type)) SELECT sr_id, count(DISTINCT doc_id) AS n_clauses, count(DISTINCT a) AS n_actions FROM x GROUP BY sr_id"


@query(EXPOSURE)
def a13_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements by the documents of the actions that cite them."""
    key = F.concat_ws("/", "source", "finding_type").alias("action")
    members = K.action_members(_rated(spark, sf_dir), "source", item="doc_id").select(key, F.col("doc_id").alias("clause_id"))
    found = _assessed(spark, sf_dir).where("assessment <> 'VALID'").withColumnRenamed("assessment", "finding_type")
    hits = M.match_patterns(found, demo.CATALOGUE, text="line", keys=["doc_id", "source", "finding_type"]).where("hits > 0")
    return K.exposure(members, hits.select(key, "sr_id", F.col("doc_id").alias("clause_id")), "action").select("sr_id", "n_clauses", "n_actions")


def _line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of lines: a clause is a line, ``clause_id`` is doc_id:pos."""
    rows = _rated(spark, sf_dir)
    return rows.withColumn("clause_id", F.concat_ws(":", "doc_id", "pos"))


def _line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _matches(spark, sf_dir).where("hits > 0").withColumn("position", F.struct("doc_id", "pos"))
    return rows.select("source", F.concat_ws(":", "doc_id", "pos").alias("clause_id"), "position", "sr_id", "framework", "match_type", F.col("match_confidence").cast("double").alias("match_confidence"))


_CITED = "cited AS (SELECT s.source, s.assessment AS finding_type, m.sr_id, m.framework, m.match_type, CAST(round(m.match_confidence * 100) AS INT) AS confidence, s.doc_id || ':' || s.pos AS source_clause, s.doc_id, s.pos FROM scores s JOIN matches m USING (doc_id, pos) WHERE s.assessment <> 'VALID' AND m.hits > 0), evidence AS (SELECT * FROM cited QUALIFY row_number() OVER (PARTITION BY source, finding_type, sr_id ORDER BY doc_id, pos) = 1)"


@query(f"WITH {SCORES}, {_CITED} SELECT source, finding_type, sr_id, framework, match_type, confidence, source_clause, CAST(row_number() OVER (PARTITION BY source, finding_type ORDER BY doc_id, pos, sr_id) AS INT) AS place FROM evidence")
def a12_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each requirement of an action by its first match."""
    return K.action_evidence(_line_findings(spark, sf_dir), _line_matches(spark, sf_dir), "source")


@query(f"WITH {SCORES}, rows AS (SELECT source, assessment AS finding_type, doc_id, pos, severity, pos // 40 + 1 AS page, trim(line) AS problem, 'Page ' || (pos // 40 + 1) AS guidance, 'Change ' || doc_id || ':' || pos AS change, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 99 END AS r FROM scores WHERE assessment <> 'VALID'), parts AS (SELECT *, problem AS text, 0 AS kind FROM rows UNION ALL SELECT *, guidance, 1 FROM rows), once AS (SELECT * FROM parts WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY source, finding_type, text ORDER BY r, doc_id, pos, kind) = 1), texts AS (SELECT source, finding_type, string_agg(text, ' | ' ORDER BY r, doc_id, pos) FILTER (kind = 0) AS p, string_agg(text, ' | ' ORDER BY r, doc_id, pos) FILTER (kind = 1) AS g FROM once GROUP BY ALL), pages AS (SELECT source, finding_type, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM rows GROUP BY ALL), head AS (SELECT source, finding_type, arg_min(change, struct_pack(a := r, b := doc_id, c := pos)) AS change FROM rows GROUP BY ALL) SELECT source, finding_type, pages, coalesce(p, 'See finding type.') AS remediation_summary, coalesce(g, '') AS negotiation_guidance, change AS suggested_contract_change FROM head JOIN pages USING (source, finding_type) LEFT JOIN texts USING (source, finding_type)")
def a12_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and merged texts of an action; a line stands for the problem of its clause."""
    rows, page = _line_findings(spark, sf_dir), F.floor(F.col("pos") / 40) + 1
    proposals = rows.select("source", "clause_id", "severity", F.trim("line").alias("problem_summary"), F.concat(F.lit("Page "), page).alias("negotiation_guidance"), F.concat(F.lit("Change "), "clause_id").alias("suggested_clause"))
    pages = ordered_distinct(rows, ["source", "finding_type"], page, page, "pages").withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))
    return K.action_texts(rows, proposals, "source").join(pages, ["source", "finding_type"])


def _stored_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings, without their texts, and matches for several readers: the texts meet the patterns once for each."""
    return stored(_line_findings(spark, sf_dir).drop("line"), "findings"), stored(_line_matches(spark, sf_dir), "matches")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, matches = _stored_lines(spark, sf_dir)
    items = K.action_plan(rows, "source").select("source", "finding_type", F.format_string("NEG-%03d", "action_no").alias("item_id"))
    return K.exposure_index(matches, K.action_members(rows, "source"), K.action_evidence(rows, matches, "source"), items, "source")


_ITEMS = f"{_CITED}, plan AS (SELECT source, assessment AS finding_type, min(CASE WHEN risk_score >= 7 THEN 0 WHEN risk_score >= 4 THEN 1 ELSE 2 END) AS p, round(max(risk_score), 2) AS max_score FROM scores WHERE assessment <> 'VALID' GROUP BY ALL), items AS (SELECT *, printf('NEG-%03d', CAST(row_number() OVER (PARTITION BY source ORDER BY p, max_score DESC, finding_type) AS INT)) AS item_id FROM plan)"


@query(f"WITH {SCORES}, {_ITEMS}, heads AS (SELECT source, sr_id, framework, match_type, CAST(round(match_confidence * 100) AS INT) AS confidence FROM matches WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY source, sr_id ORDER BY doc_id, pos) = 1), negs AS (SELECT source, sr_id, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS neg_ids FROM evidence JOIN items USING (source, finding_type) GROUP BY ALL) SELECT source, sr_id, framework, match_type, confidence, coalesce(neg_ids, '') AS neg_ids FROM heads LEFT JOIN negs USING (source, sr_id)")
def a13_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each requirement with its first match and the negotiation items that cite it."""
    head, _, cited = _index(spark, sf_dir)
    listed = ordered_distinct(cited, ["source", "sr_id"], F.col("item_id"), F.col("item_id"), "neg_ids")
    return head.join(listed, ["source", "sr_id"], "left").withColumn("neg_ids", F.coalesce(F.array_join("neg_ids", ","), F.lit("")))


@query(f"WITH {SCORES}, {_ITEMS}, own AS (SELECT source, sr_id, doc_id, pos, 0 AS f, '' AS item_id FROM matches WHERE hits > 0 UNION ALL SELECT e.source, e.sr_id, s.doc_id, s.pos, 1, i.item_id FROM evidence e JOIN items i USING (source, finding_type) JOIN scores s ON s.source = e.source AND s.assessment = e.finding_type), once AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY source, sr_id, doc_id, pos ORDER BY f, item_id) = 1) SELECT source, sr_id, doc_id || ':' || pos AS clause_id, f = 0 AS matched, item_id AS first_item FROM once")
def a13_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses of each requirement, those that match before those that negotiation items bring."""
    _, clauses, _ = _index(spark, sf_dir)
    return clauses.select("source", "sr_id", "clause_id", (F.col("at.from") == 0).alias("matched"), F.col("at.by").alias("first_item"))
