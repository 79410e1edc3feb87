"""Operators on small texts whose results are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import classify, compliance, library, matching, obligations, segments, store
from tessera.packs import CATALOGUE
from tessera.sources import files


def clauses(spark, *texts):
    return spark.createDataFrame([(f"CL-{i + 1:03d}", t) for i, t in enumerate(texts)], "clause_id string, text string")


def test_obligations_first_group_wins(spark):
    rows = clauses(
        spark,
        "Provider shall assume all ICT-related regulatory duties and use best efforts.",
        "Provider shall determine the legal basis for processing.",
        "The customer has unlimited, unrestricted audit access.",
        "Notify parties immediately.",
        "The provider follows applicable law of Germany.",
        "The provider follows applicable laws of Germany.",
        "The provider uses best efforts.",
        "Fees are due monthly.",
        None,
    )
    got = [(r.assessment, r.severity) for r in obligations.assess(rows).orderBy("clause_id").collect()]
    assert got == [("NON_TRANSFERABLE_REGULATION", "HIGH"), ("CUSTOMER_RESPONSIBILITY", "MEDIUM"), ("OPERATIONAL_RISK", "HIGH"), ("OPERATIONAL_RISK", "MEDIUM"), ("VALID", "LOW"), ("SCOPE_UNDEFINED", "MEDIUM"), ("AMBIGUOUS_REQUIREMENT", "MEDIUM"), ("VALID", "LOW"), ("VALID", "LOW")]


def test_match_types_and_confidence(spark):
    rows = clauses(spark, "Business continuity and disaster recovery with RTO.", "Early warning only.", "Nothing here.")
    got = {(r.clause_id, r.sr_id): (r.match_type, round(r.match_confidence, 2)) for r in matching.match_patterns(rows).where("hits > 0").collect()}
    assert got == {("CL-001", "SR-ISO27001-02"): ("DIRECT_MATCH", 0.90), ("CL-002", "SR-NIS2-01"): ("PARTIAL_MATCH", 0.65)}


def test_applicability():
    ids = {r.sr_id for r in matching.applicable(CATALOGUE, ["ISO27001", "DORA", "NIS2", "GDPR"], "SAAS", "HIGH")}
    assert len(ids) == 10 and not ids & {"SR-DORA-03", "SR-GDPR-02"}


def test_classification_ties_and_lost_hyphens(spark):
    docs = spark.createDataFrame([(1, "The data processor handles personal data as a sub-processor."), (2, "web-based third-party ict non-disclosure"), (3, "nothing")], "doc_id long, text string")
    got = [(r.contract_type, r.type_hits, r.data_sensitivity) for r in classify.classify(docs).orderBy("doc_id").collect()]
    assert got == [("DATA_PROCESSING", 3, "PERSONAL_DATA"), ("ICT_OUTSOURCING", 1, "INTERNAL"), ("OTHER", 0, "INTERNAL")]


def test_risk_scores(spark):
    rows = spark.createDataFrame(
        [("a", "OPERATIONAL_RISK", "HIGH", "AUDIT_RIGHTS"), ("b", "CUSTOMER_RESPONSIBILITY", "MEDIUM", "DATA_PROTECTION"), ("c", "AMBIGUOUS_REQUIREMENT", "MEDIUM", "SECURITY_CONTROLS"), ("d", "VALID", "LOW", None), ("e", None, None, None)],
        "clause_id string, assessment string, severity string, topic string",
    )
    matches = spark.createDataFrame([("a", "PARTIAL_MATCH", 0.66), ("b", "PARTIAL_MATCH", 0.7), ("d", "NO_MATCH", 0.0)], "clause_id string, match_type string, match_confidence double")
    score = lambda **k: {r.clause_id: r.risk_score for r in compliance.clause_scores(rows, matches, **k).collect()}
    assert score() == {"a": 8.75, "b": 6.25, "c": 6.0, "d": 1.5, "e": 2.0}
    assert score(compat_null_assessment=True)["e"] == 6.0


def test_decision_and_owner(spark):
    rows = spark.createDataFrame([(1, "HIGH", "MISSING"), (1, "LOW", "COMPLIANT"), (2, "HIGH", "WEAK_MATCH"), (3, "LOW", "MISSING")], "c int, severity string, finding_type string")
    assert {r.c: r.decision for r in compliance.decision(rows, "c").collect()} == {1: "REJECT", 2: "CONDITIONAL_APPROVAL", 3: "APPROVE"}
    assert spark.range(1).select(compliance.owner(F.lit("GDPR"), F.lit("MISSING")).alias("o")).first().o == "DPO"


def test_zero_penalty_is_not_lost(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.0), (2, 0.5), (2, 0.5)], "k int, f double")
    assert {r.k: r.factor for r in library.penalty(rows, "k", "f").collect()} == {1: 0.0, 2: 0.25}


def test_orphan_pairs(spark):
    rows = spark.createDataFrame([(1, i, o) for i, o in enumerate([True, True, True, False, True])], "d int, pos int, o boolean")
    got = [r.merge_with_next for r in segments.pair_orphans(rows, "d", "pos", F.col("o")).orderBy("pos").collect()]
    assert got == [True, False, True, False, False]


def test_segments_and_tables(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(["body", "heading", "body", "table", "body"])], "d int, pos int, kind string")
    got = [r.seg for r in segments.segments(rows, "d", "pos", F.col("kind") == "heading", F.col("kind") == "table").orderBy("pos").collect()]
    assert got == [1, 2, 2, 3, 4]


def test_paragraphs_and_kinds(spark):
    text = "1. Scope\n\nThe text of it.\f\n\nCONFIDENTIALITY OBLIGATIONS\n\nThe following applies:\n\n12\n\n"
    rows = segments.paragraphs(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = [(r.page, r.kind) for r in rows.withColumn("kind", segments.block_kind(F.col("text"))).orderBy("pos").collect()]
    assert got == [(1, "heading"), (1, "body"), (2, "skip"), (2, "heading_colon"), (2, "skip")]


def test_shortlist_cap(spark):
    det = spark.createDataFrame([("c", "a"), ("c", "b")], "c string, s string")
    sim = spark.createDataFrame([("c", "b", 0.9), ("c", "x", 0.5), ("c", "y", 0.7)], "c string, s string, score double")
    assert {r.s for r in matching.shortlist(det, sim, "c", "s", cap=3).collect()} == {"a", "b", "y"}


def test_evaluation(spark):
    p = spark.createDataFrame([("1", "D"), ("2", "P"), ("4", "D")], "k string, match_type string")
    e = spark.createDataFrame([("1", "D"), ("2", "D"), ("3", "D")], "k string, match_type string")
    assert tuple(matching.evaluate(p, e, ["k"]).first()) == (2, 1, 1, 0.6667, 0.6667, 0.6667)
    assert tuple(matching.evaluate(p, e, ["k"], strict=True).first())[:3] == (1, 2, 2)


def test_readiness(spark):
    rows = spark.createDataFrame([(1, "HIGH", None), (2, "MEDIUM", "deferred"), (3, "LOW", "open"), (4, "HIGH", "odd")], "v int, severity string, status string")
    assert {r.v: r.readiness for r in compliance.readiness(rows, "v").collect()} == {1: "blocked", 2: "review_required", 3: "ready_for_approval", 4: "ready_for_conditional_approval"}


def test_json_of_either_shape(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"chunk_id": "1", "text": "x"}]')
    (tmp_path / "b.json").write_text('{"chunks": [{"chunk_id": "2", "text": "y"}]}')
    got = files.json_rows(spark, str(tmp_path), "chunk_id string, text string", "chunks")
    assert sorted(map(tuple, got.collect())) == [("1", "x"), ("2", "y")]
    with pytest.raises(ValueError):
        files.require_fields(got, ["page"])


def test_text_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("für".encode())
    (tmp_path / "b.txt").write_bytes("für".encode("latin-1"))
    assert [r.text for r in files.text_contracts(spark, str(tmp_path)).collect()] == ["für", "für"]


def test_bundle_is_stable():
    assert files.bundle({"a.md": "x", "b.json": "{}"}) == files.bundle({"b.json": "{}", "a.md": "x"})


def test_upsert_and_ids(spark):
    old, new = spark.createDataFrame([("k1",)], "k string"), spark.createDataFrame([("k1", 1), ("k2", 3), ("k2", 2)], "k string, n int")
    got = store.number(store.upsert_skip(old, new, ["k"], F.col("n")), "NEG-2026-", F.col("k"))
    assert [tuple(r) for r in got.collect()] == [("k2", 2, "NEG-2026-001")]
