"""Scores by one projection are those of the join."""

from tessera.operators import compliance, matching
from tessera.packs import CATALOGUE


def test_scores_of_text_equal_scores_of_matches(spark):
    texts = ["Business continuity and disaster recovery with RTO.", "Early warning only.", "Nothing here.", "", None]
    kinds = [("OPERATIONAL_RISK", "HIGH", "AUDIT_RIGHTS"), ("AMBIGUOUS_REQUIREMENT", "MEDIUM", "SECURITY_CONTROLS"), ("VALID", "LOW", None), (None, None, None)]
    rows = spark.createDataFrame([(f"{i}-{j}", t, *k) for i, t in enumerate(texts) for j, k in enumerate(kinds)], "clause_id string, text string, assessment string, severity string, topic string")
    for compat in (False, True):
        joined = compliance.clause_scores(rows, matching.match_patterns(rows), compat_null_assessment=compat)
        once = compliance.clause_scores_of(rows, CATALOGUE, compat_null_assessment=compat)
        assert joined.columns == once.columns
        assert sorted(map(repr, joined.collect())) == sorted(map(repr, once.collect()))
        assert once.count() == 20 and compliance.clause_scores_of(rows.where("false"), CATALOGUE).count() == 0
