"""Messages to a model as column expressions, and the check of what it answers. The wording is ours; systems' instructions are parameters of the call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(**parts: Column) -> Column:
    """``Name: value`` lines; a null value stands as a dash."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{n.replace('_', ' ')}: "), F.coalesce(c.cast("string"), F.lit("-"))) for n, c in parts.items()])


def _block(title: str, text: Column, empty: str = "(not available)") -> Column:
    return F.concat(F.lit(f"\n\n{title}:\n"), F.coalesce(F.nullif(text, F.lit("")), F.lit(empty)))


def obligation_message(clause_id: Column, page: Column, layout: Column, text: Column, schema: str) -> Column:
    """Asks for the assessment of one clause, as JSON of ``schema``."""
    return F.concat(_lines(Clause=clause_id, Page=page, Layout=layout), _block("Text", text), _block("Answer as JSON of", F.lit(schema)))


def match_message(clause_id: Column, page: Column, text: Column, requirement: dict[str, Column], match_type: Column, confidence: Column, evidence: Column) -> Column:
    """Asks whether one clause addresses one requirement (sr_id, framework, control, title), which patterns have judged before; 200 characters of evidence go along."""
    judged = _lines(Match=match_type, Confidence=confidence, Evidence=F.substring(F.coalesce(evidence, F.lit("none")), 1, 200))
    return F.concat(_lines(Clause=clause_id, Page=page), _block("Text", text), _block("Requirement", _lines(**requirement)), _block("By patterns", judged), F.lit("\n\nConfirm, refine or overrule this."))


def remediation_message(clause_id: Column, finding_type: Column, severity: Column, reason: Column, text: Column, problem: Column) -> Column:
    """Asks for replacement wording of one clause, from the problem that rules name."""
    return F.concat(_lines(Clause=clause_id, Finding=F.coalesce(finding_type, F.lit("UNKNOWN")), Severity=F.coalesce(severity, F.lit("MEDIUM")), Reason=F.coalesce(reason, F.lit("N/A"))), _block("Text", text), _block("Problem by rules", problem))


# What each layout asks for besides, by the kinds that ``elements.prompt_of`` tells apart.
_KINDS = {
    "table": "Each row that binds a party is a clause; keep its column names.",
    "list": "An introduction and its items are one clause unless an item stands by itself.",
    "ocr": "The text was recognised by machine: repair nothing, mark what cannot be read.",
    "heading": "A heading has content only if it binds a party itself.",
    "paragraph": "A sentence that binds a party begins a clause.",
}


def extraction_message(kind: Column, text: Column, section: Column, chunk: Column, chunks: Column, confidence: Column | None = None) -> Column:
    """Asks for the clauses of one chunk; ``kind`` is that of its layout, others are taken as paragraphs."""
    asked = F.lit(_KINDS["paragraph"])
    for k, t in _KINDS.items():
        asked = F.when(kind == k, t).otherwise(asked)
    seen = F.when(kind == "ocr", F.concat(F.lit("\nRecognition: "), F.coalesce(F.format_string("%.2f", confidence.cast("double")), F.lit("-")))).otherwise("") if confidence is not None else F.lit("")
    place = F.concat(chunk.cast("string"), F.lit(" of "), chunks.cast("string"))
    return F.concat(_lines(Section=F.coalesce(section, F.lit("Unknown Section")), Chunk=place), seen, _block("Text", text), F.lit("\n\n"), asked)


CLAUSES = "array<struct<clause_text: string, starts_at_char: int, ends_at_char: int, is_continuation: boolean, is_truncated: boolean>>"


def extraction_answer(answer: Column) -> Column:
    """Struct of problem (null where the answer is good) and clauses (null where it is not).

    Problems, the first that holds: not JSON, no list of clauses, no flag of content, a clause lacks a field or has another type in it, a clause without text.
    """
    whole = F.from_json(answer, f"clauses {CLAUSES}, chunk_has_operative_content boolean")
    given = whole["clauses"]
    lacks = F.exists(given, lambda c: c.isNull() | c["clause_text"].isNull() | c["starts_at_char"].isNull() | c["ends_at_char"].isNull() | c["is_continuation"].isNull() | c["is_truncated"].isNull())
    blank = F.exists(given, lambda c: F.trim(c["clause_text"]) == "")
    problem = (
        F.when(answer.isNull() | F.try_parse_json(answer).isNull(), "not JSON")
        .when(given.isNull(), "no list of clauses")
        .when(whole["chunk_has_operative_content"].isNull(), "no flag of content")
        .when(lacks, "a clause lacks a field")
        .when(blank, "a clause without text")
    )
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), given).alias("clauses"))


# The opening of a negotiation item by finding type and priority, where it differs from the plain one.
OPENINGS = {
    ("NON_TRANSFERABLE_REGULATION", "HIGH"): "Reject the transfer of reporting duties; offer assistance instead. Such duties stay with the regulated party ({refs}) in clauses {clauses}.",
    ("OPERATIONAL_RISK", "HIGH"): "Replace terms that cannot be met in clauses {clauses} by levels of service in line with {refs}.",
}


def argument(finding_type: Column, priority: Column, guidance: Column, references: Column, clauses: Column, positions: Column) -> Column:
    """A negotiation item's argument: its opening by (type, priority), else guidance and regulatory basis; then the topics' positions. ``references`` and
    ``clauses`` are arrays, ``positions`` an array that may hold nulls and empties."""
    refs = F.when(F.size(references) > 0, F.array_join(references, " · ")).otherwise("no direct match on record")
    named = F.array_join(clauses.cast("array<string>"), ", ")
    opening = F.concat(F.lit("Position: "), F.coalesce(guidance, F.lit("")), F.lit("\n\nRegulatory basis: "), refs, F.lit("."))
    for (kind, level), text in OPENINGS.items():
        filled = F.replace(F.replace(F.lit(text), F.lit("{refs}"), refs), F.lit("{clauses}"), named)
        opening = F.when((finding_type == kind) & (priority == level), filled).otherwise(opening)
    held = F.array_join(F.filter(positions, lambda p: p.isNotNull() & (p != "")), " | ")
    return F.concat(opening, F.when(held != "", F.concat(F.lit("\n\n"), held)).otherwise(""))
