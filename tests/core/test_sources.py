"""Folders of mixed files, prompts and arguments."""

import json
import zipfile

from pyspark.sql import functions as F

from tessera.functions import prompts as P
from tessera.operators import elements
from tessera.sources import mixed
from tessera.sources.docx import docx_tables
from tessera.sources.files import raw_files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")


def para(t):
    return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def test_a_bad_file_costs_its_own_row(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text("The provider shall report.\n\nSecond paragraph here.\fNext page text.")
    (tmp_path / "deep" / "latin.TXT").write_bytes("Der Auftragnehmer muß prüfen.".encode("latin-1"))
    (tmp_path / "empty.txt").write_text("")
    word(tmp_path / "b.docx", para("A clause of a Word file.") + table(("Term", "Value", ""), ("Notice", "30 days", "x"), ("Fee", "none")))
    (tmp_path / "broken.docx").write_bytes(b"PK\x03\x04 no archive")
    (tmp_path / "plain.docx").write_text("not a Word file at all")
    (tmp_path / "c.json").write_text(json.dumps([{"clause_id": "1", "text": "From a list of clauses."}, {"clause_id": "2"}]))
    (tmp_path / "d.json").write_text(json.dumps({"clauses": [{"text": "From an envelope of them.", "page": 4}]}))
    (tmp_path / "bad.json").write_text("{ not json")
    (tmp_path / "other.json").write_text('{"x": 1}')
    (tmp_path / "scan.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "nosuffix").write_text("who knows")
    (tmp_path / "big.txt").write_text("x" * 5000)
    got = {}
    for r in sorted(mixed.mixed_blocks(spark, str(tmp_path), max_bytes=4000).collect(), key=lambda r: (r.path, r.pos)):
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.page, r.text, r.error))
    assert got.pop("broken.docx")[0][2]
    assert got == {
        "a.txt": [(1, "The provider shall report.", None), (1, "Second paragraph here.", None), (2, "Next page text.", None)],
        "latin.TXT": [(1, "Der Auftragnehmer muß prüfen.", None)],
        "b.docx": [(1, "A clause of a Word file.", None), (1, "Term | Value | \nNotice | 30 days | x\nFee | none", None)],
        "plain.docx": [(0, None, "not a Word file")],
        "c.json": [(1, "From a list of clauses.", None)],
        "d.json": [(4, "From an envelope of them.", None)],
        "bad.json": [(0, None, "not JSON")],
        "other.json": [(0, None, "no list of items")],
        "scan.pdf": [(0, None, "no reader for .pdf")],
        "nosuffix": [(0, None, "no suffix")],
        "big.txt": [(0, None, "too large")],
    }
    cells = docx_tables(raw_files(spark, str(tmp_path))).orderBy("row").collect()
    assert [(r.table, r.row, r.cells) for r in cells] == [(0, 1, {"Term": "Notice", "Value": "30 days", "2": "x"}), (0, 2, {"Term": "Fee", "Value": "none"})]


def test_messages(spark):
    rows = spark.createDataFrame([("CL-1", 3, "table", "a | b", None), ("CL-2", None, "ocr_text", "", 0.5)], "id string, page int, layout string, text string, conf double")
    kind = elements.prompt_of(F.col("layout"))
    one, two = rows.select(P.extraction_message(kind, F.col("text"), F.lit(None).cast("string"), F.lit(1), F.lit(9), F.col("conf")).alias("m"), P.obligation_message(F.col("id"), F.col("page"), F.col("layout"), F.col("text"), "{}").alias("o")).orderBy("id").collect()
    assert one.m == "Section: Unknown Section\nChunk: 1 of 9\n\nText:\na | b\n\n" + P._KINDS["table"]
    assert two.m.startswith("Section: Unknown Section\nChunk: 1 of 9\nRecognition: 0.50\n\nText:\n(not available)")
    assert two.o == "Clause: CL-2\nPage: -\nLayout: ocr_text\n\nText:\n(not available)\n\nAnswer as JSON of:\n{}"
    asked = rows.select(P.match_message(F.col("id"), F.col("page"), F.col("text"), {"SR": F.lit("SR-1"), "Title": F.lit("Audit")}, F.lit("DIRECT_MATCH"), F.lit(0.9), F.lit("e" * 300)).alias("m"), P.remediation_message(F.col("id"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("text"), F.lit("p")).alias("r")).first()
    assert "SR: SR-1\nTitle: Audit" in asked.m and "e" * 200 in asked.m and "e" * 201 not in asked.m
    assert "Finding: UNKNOWN\nSeverity: MEDIUM\nReason: N/A" in asked.r


def test_arguments(spark):
    rows = spark.createDataFrame([("OPERATIONAL_RISK", "HIGH", "g", ["SR-1 (DORA)"], ["A", "B"], ["pos", None, ""]), ("OPERATIONAL_RISK", "LOW", "g", [], ["A"], [])], "t string, p string, g string, r array<string>, c array<string>, x array<string>")
    a, b = (r[0] for r in rows.select(P.argument(*map(F.col, "tpgrcx"))).collect())
    assert a == "Replace terms that cannot be met in clauses A, B by levels of service in line with SR-1 (DORA).\n\npos"
    assert b == "Position: g\n\nRegulatory basis: no direct match on record."
