"""Readers and writers of files: raw contracts, JSON of either shape, reports and bundles."""

from __future__ import annotations

import hashlib
import json
import zipfile
from io import BytesIO

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 << 20


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and what ``sniff`` tells of every file under ``path``."""
    return sniff(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def sniff(rows: DataFrame) -> DataFrame:
    """Adds n_bytes, sha256, kind (by the first bytes) and accepted (within the size limit)."""
    head = F.substring("content", 1, 4)
    kind = F.when(head == F.unhex(F.lit("25504446")), "pdf").when(F.substring("content", 1, 2) == F.unhex(F.lit("504B")), "docx").otherwise("txt")
    return rows.withColumn("n_bytes", F.octet_length("content")).withColumn("sha256", F.sha2("content", 256)).withColumn("kind", kind).withColumn("accepted", F.col("n_bytes") <= MAX_BYTES)


def text_contracts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), text: UTF-8, or Latin-1 where that fails."""
    rows = raw_files(spark, path).where("kind = 'txt' and accepted")
    broken = ~F.expr("is_valid_utf8(cast(content as string))")
    return rows.select(F.col("path").alias("doc_id"), F.when(broken, F.decode("content", "ISO-8859-1")).otherwise(F.decode("content", "UTF-8")).alias("text"))


def json_rows(spark: SparkSession, path: str, schema: str, envelope: str) -> DataFrame:
    """Rows of JSON files that hold an array, or an object with the array under ``envelope``."""
    whole = spark.read.text(path, wholetext=True)
    inside = F.from_json("value", f"struct<{envelope}: array<struct<{schema}>>>")[envelope]
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{schema}>>")).otherwise(inside)
    return whole.select(F.explode(listed).alias("x")).select("x.*")


def load_benchmark(spark: SparkSession, path: str) -> DataFrame | None:
    """clause_id, sr_id, expected_match_type of a benchmark file; None where it is missing, broken or without a list of clauses."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None
    kind = "struct<clauses: array<struct<clause_id: string, expected_matches: array<struct<sr_id: string, expected_match_type: string>>>>>"
    rows = whole.select(F.from_json("value", kind)["clauses"].alias("c"))
    if rows.where("c is not null").isEmpty():
        return None
    clauses = rows.select(F.explode("c").alias("c"))
    return clauses.select("c.clause_id", F.explode("c.expected_matches").alias("m")).select("clause_id", "m.sr_id", "m.expected_match_type")


def require_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The rows themselves; a missing column is an error at once, before any job."""
    if lost := [f for f in fields if f not in rows.columns]:
        raise ValueError(f"missing fields: {', '.join(lost)}")
    return rows


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def markdown_table(rows: DataFrame) -> DataFrame:
    """One column of Markdown rows, in no order; ``markdown_head`` gives the first two lines."""
    return rows.select(F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), " | "), F.lit(" |")).alias("value"))


def markdown_head(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"


def mermaid_edges(edges: DataFrame, source: str, target: str, label: str) -> DataFrame:
    """One line of a Mermaid graph for every edge."""
    node = lambda c: F.regexp_replace(F.col(c).cast("string"), r"[^A-Za-z0-9]", "_")
    return edges.select(F.format_string("    %s -->|%s| %s", node(source), F.col(label), node(target)).alias("value"))


def bundle(parts: dict[str, str]) -> bytes:
    """A zip of small report files with a manifest of their sha256; the manifest inside has no hash of the bundle."""
    manifest = {"files": {n: hashlib.sha256(t.encode()).hexdigest() for n, t in sorted(parts.items())}, "bundle_hash": None}
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, t in sorted(parts.items()):
            z.writestr(zipfile.ZipInfo(n), t)
        z.writestr(zipfile.ZipInfo("manifest.json"), json.dumps(manifest, indent=2))
    return out.getvalue()
