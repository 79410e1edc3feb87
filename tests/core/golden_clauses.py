"""The clauses of the published evaluation and the requirements expected of them."""

# clause, text
CLAUSES = [
    ("CL-001", "The Vendor shall maintain a comprehensive information security policy that is reviewed annually and aligns with ISO 27001 requirements. The policy shall cover all aspects of the information security management system."),
    ("CL-002", "The Vendor shall handle all data subject rights requests including the right of access under Art. 15, the right to erasure under Art. 17, and the right to data portability under Art. 20 within statutory timelines."),
    ("CL-003", "Vendor shall maintain business continuity and disaster recovery plans with a recovery time objective (RTO) of 4 hours and recovery point objective (RPO) of 1 hour for critical systems."),
    ("CL-004", "In the event of a significant incident affecting data availability, the Vendor shall provide an early warning within 24 hours and submit a full report to the Customer within 72 hours of becoming aware."),
    ("CL-005", "The Vendor shall implement and maintain an ICT risk management framework that satisfies digital operational resilience requirements applicable to financial entities under DORA."),
    ("CL-006", "The Customer retains the right to audit the Vendor's security controls and may engage a third-party audit firm at any time with 30 days' notice. The Vendor shall provide SOC 2 Type II reports upon request."),
    ("CL-007", "The Vendor maintains a list of subprocessors and shall notify the Customer 30 days in advance of any changes pursuant to GDPR Art. 28(4). The subprocessor notification procedure is described in Annex B."),
    ("CL-008", "The Vendor shall conduct vendor security assessments for all subcontractors who process Customer data and maintain supply chain security controls consistent with applicable regulatory requirements."),
    ("CL-009", "The vendor's ISMS documentation is regularly reviewed and updated to reflect current threat intelligence and security control effectiveness. Findings are tracked to closure."),
    ("CL-010", "All personal data transferred to countries outside the European Economic Area shall be protected by appropriate safeguards that ensure equivalent protection levels consistent with applicable data protection law."),
    ("CL-011", "The Vendor shall promptly notify relevant supervisory bodies of any operational disruption that materially affects the continuity of critical financial services provided under this agreement."),
    ("CL-012", "The Vendor's information security management system (ISMS) shall address business continuity and disaster recovery planning as mandatory control areas with documented recovery procedures."),
    ("CL-013", "The Vendor shall provide monthly status reports covering service availability metrics, incident counts by category, and a summary of change management activities during the reporting period."),
    ("CL-014", "Payment terms are net 30 from the date of invoice. Invoices not disputed within 10 business days are deemed accepted. Late payments incur a 1.5% monthly interest charge."),
    ("CL-015", "The Vendor shall report any major ICT-related incidents to competent authorities within the timelines prescribed by DORA Art. 17 and Art. 19, and simultaneously notify the Customer's designated contact."),
]
# clause, requirement, kind of match
EXPECTED = [
    ("CL-001", "SR-ISO27001-01", "DIRECT_MATCH"),
    ("CL-002", "SR-GDPR-01", "DIRECT_MATCH"),
    ("CL-003", "SR-ISO27001-02", "DIRECT_MATCH"),
    ("CL-004", "SR-NIS2-01", "DIRECT_MATCH"),
    ("CL-005", "SR-DORA-01", "DIRECT_MATCH"),
    ("CL-006", "SR-ISO27001-03", "DIRECT_MATCH"),
    ("CL-007", "SR-GDPR-04", "DIRECT_MATCH"),
    ("CL-008", "SR-NIS2-02", "DIRECT_MATCH"),
    ("CL-009", "SR-ISO27001-01", "DIRECT_MATCH"),
    ("CL-010", "SR-GDPR-03", "PARTIAL_MATCH"),
    ("CL-011", "SR-DORA-02", "PARTIAL_MATCH"),
    ("CL-012", "SR-ISO27001-01", "DIRECT_MATCH"),
    ("CL-012", "SR-ISO27001-02", "DIRECT_MATCH"),
    ("CL-015", "SR-DORA-02", "DIRECT_MATCH"),
]
