"""Word files as ordered blocks, by the standard library alone; PDF needs pdfminer, which may be absent."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, pos int, page int, kind string, text string"


def blocks_of(content: bytes) -> list[tuple[int, str, str]]:
    """(page, kind, text): paragraphs by style and boldness, tables as ``a | b`` rows without repeated neighbours."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out, page = [], 1
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    for node in body if body is not None else []:
        if any(b.get(f"{_W}type") == "page" for b in node.iter(f"{_W}br")) or next(node.iter(f"{_W}lastRenderedPageBreak"), None) is not None:
            page += 1
        if node.tag == f"{_W}p" and (text := words(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            runs = [r for r in node.iter(f"{_W}r") if words(r)]
            bold = bool(runs) and all(r.find(f"{_W}rPr/{_W}b") is not None for r in runs)
            kind = "toc" if name.startswith("toc") else "skip" if name in ("header", "footer") else "heading" if name.startswith("heading") or name == "title" or (bold and len(text) <= 200) else "body"
            out.append((page, kind, text))
        elif node.tag == f"{_W}tbl":
            rows = []
            for row in node.iter(f"{_W}tr"):
                cells = [words(c) for c in row.iter(f"{_W}tc")]
                rows.append(" | ".join(c for i, c in enumerate(cells) if i == 0 or c != cells[i - 1]))
            out.append((page, "body", "\n".join(rows)))
    return out


def docx_blocks(files: DataFrame) -> DataFrame:
    """Blocks of files(path, content) of kind docx; a broken file gives one row of kind ``error``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                try:
                    got = blocks_of(bytes(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    got = [(0, "error", str(e))]
                yield pd.DataFrame([(path, i, *b) for i, b in enumerate(got)], columns=["path", "pos", "page", "kind", "text"])

    return files.where("kind = 'docx'").select("path", "content").mapInPandas(run, BLOCKS)


def tables_of(content: bytes) -> list[tuple[int, int, dict[str, str]]]:
    """(table, row, cells by header) of every row under a table's first one, whose cells are the header; a cell without one is named by its number, a
    repeated name keeps its first cell."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for t, table in enumerate(body.iter(f"{_W}tbl") if body is not None else []):
        rows = [["".join(x.text or "" for x in c.iter(f"{_W}t")).strip() for c in row.iter(f"{_W}tc")] for row in table.iter(f"{_W}tr")]
        for i, row in enumerate(rows[1:], 1):
            named: dict[str, str] = {}
            for j, cell in enumerate(row):
                named.setdefault(rows[0][j] if j < len(rows[0]) and rows[0][j] else str(j), cell)
            out.append((t, i, named))
    return out


def docx_tables(files: DataFrame) -> DataFrame:
    """path, table, row, cells (header -> text) of files(path, content, kind); broken files, which ``docx_blocks`` names, give none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                try:
                    got = tables_of(bytes(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    got = []
                yield pd.DataFrame([(path, *r) for r in got], columns=["path", "table", "row", "cells"])

    return files.where("kind = 'docx'").select("path", "content").mapInPandas(run, "path string, table int, row int, cells map<string,string>")
