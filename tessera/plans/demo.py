"""Packs for the supplied tables, whose prose is invented: the regulatory packs would match nothing there.

Patterns avoid what RE2 lacks, so that the same strings run in the checking SQL.
"""

from __future__ import annotations

from tessera.packs import ObligationPack, Requirement, RuleGroup

OBLIGATIONS = ObligationPack(
    (
        RuleGroup("NON_TRANSFERABLE_REGULATION", "HIGH", ("license", "[a-z0-9]@[a-z]")),
        RuleGroup("CUSTOMER_RESPONSIBILITY", "MEDIUM", ("thble", "reand", "osga")),
        RuleGroup("OPERATIONAL_RISK", None, ("attion", "erble", "!!")),
        RuleGroup("SCOPE_UNDEFINED", "MEDIUM", ("thtion", "nicht")),
        RuleGroup("AMBIGUOUS_REQUIREMENT", "MEDIUM", ("ertion", " [|] ", "avec")),
    ),
    "!!|[*]{3}",
)
CATALOGUE = (
    Requirement("SR-A-01", "A.1", "ISO27001", "Information Policy", None, "LOW", "HIGH", ("thble", "ertion", "shand", "hehe")),
    Requirement("SR-A-02", "A.2", "ISO27001", "Audit Rights", None, "MEDIUM", "HIGH", ("attion", "wh.{0,3}ing", "thtion|ntnt", "erble", "stor")),
    Requirement("SR-B-01", "B.1", "DORA", "Incident Reporting", ("en", "de"), "HIGH", "HIGH", ("nicht", "ung[a-z]{0,4}heit", "schaft", "einver")),
    Requirement("SR-B-02", "B.2", "DORA", "Exit Strategy", ("de",), "LOW", "MEDIUM", ("ch.{0,8}keit", "zuver", "oder|aber")),
    Requirement("SR-C-01", "C.1", "GDPR", "Data Transfers", ("fr", "es"), "LOW", "HIGH", ("avec", "tionment", "queeux", "pour.{0,5}le", "ouvi")),
    Requirement("SR-C-02", "C.2", "GDPR", "Subprocessor List", None, "MEDIUM", "MEDIUM", ("mente", "ados", "para|pero", "license")),
    Requirement("SR-D-01", "D.1", "NIS2", "Early Warning", ("es",), "LOW", "HIGH", ("esas", "ado", "llar", "osga")),
)
TYPES = {"SAAS": ("thble", "hain", "stor", "web-based"), "CLOUD_HOSTING": ("nicht", "oder", "keit"), "MSP": ("avec", "pour", "dans"), "DATA_PROCESSING": ("mente", "para", "ado", "sub-processor"), "ICT_OUTSOURCING": ("ertion", "attion", "erble", "thtion", "whing")}
LEVELS = {"SPECIAL_CATEGORY": ("password", "@"), "PERSONAL_DATA": ("license", "tel"), "CONFIDENTIAL": ("hehe", "stst"), "INTERNAL": ("inin",), "PUBLIC": ("the ",)}
STRENGTHS = ((1.0, "oder|stor|heit"), (0.75, "with"), (0.5, "avec|nicht"), (0.25, "para|pero"))
