"""Elements, reports, models, Word files and the streaming extension."""

import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.operators import elements, reports, store
from tessera.plans import demo
from tessera.sources import docx, files
from tessera.streaming import ingest


def test_heading_levels(spark):
    rows = [("1. Scope", None), ("1.1 Terms", None), ("1.1.1.1 Deep", None), ("§ 5 Haftung", None), ("a) Short item", None), ("Plain text", 15.0), ("Plain text", 12.0), ("word " * 25, 20.0), ("", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, font double")
    got = [r.h for r in df.select("i", elements.heading_level(F.col("text"), F.col("font"), F.lit(10.0)).alias("h")).orderBy("i").collect()]
    assert got == [1, 2, 3, 2, 3, 1, 3, None, None]


def test_promotion_by_median(spark):
    rows = [(1, "body", 10.0, False)] * 5 + [(1, "bold head", 11.8, True), (1, "head", 13.0, False), (1, "big\n" * 5, 14.0, True)]
    got = {r.text: r.heading for r in elements.promote_headings(spark.createDataFrame(rows, "d int, text string, font double, bold boolean"), "d").collect()}
    assert got == {"body": False, "bold head": True, "head": True, "big\n" * 5: False}


def test_internal_split(spark):
    df = spark.createDataFrame([(1, 0, "intro\n1. First\ntext\n2. Second"), (1, 1, "1. A\n2. B")], "d int, pos int, t string")
    got = [(r.pos, r.part, r.text) for r in elements.split_internal(df, "d", "pos", "t").orderBy("pos", "part").collect()]
    assert got == [(0, 0, "intro"), (0, 1, "1. First\ntext"), (0, 2, "2. Second"), (1, 0, "1. A\n2. B")]


def test_primary_proposal_and_fallbacks(spark):
    df = spark.createDataFrame([("c", 0, "LOW", "x"), ("c", 1, "HIGH", "y"), ("c", 2, "HIGH", "z")], "k string, position int, severity string, proposal string")
    assert reports.primary_proposal(df, "k").first().proposal == "y"
    assert spark.range(1).select(reports.first_filled(F.lit(""), F.lit(None), F.lit("b")).alias("v")).first().v == "b"


def test_models(spark):
    calls = []

    def flaky(prompts):
        calls.append(len(prompts))
        if len(calls) < 3:
            raise ValueError
        return ["ok"] * len(prompts)

    assert models.with_retries(flaky, backoff=0)(["a"]) == ["ok"] and len(calls) == 3
    assert models.with_retries(lambda p: 1 / 0, backoff=0)(["a", "b"]) == [None, None]
    with pytest.raises(RuntimeError):
        models.with_retries(lambda p: (_ for _ in ()).throw(RuntimeError("final")))(["a"])
    df = models.complete(spark.range(250).selectExpr("cast(id as string) p"), "p", lambda ps: [str(len(ps) <= 100) for _ in ps])
    assert df.where("answer = 'true' or answer = 'True'").count() == 250
    v = spark.range(1).select(models.vector_text(F.array(F.lit(0.5), F.lit(-1.0))).alias("t"), models.vector_of(F.lit("[0.1, 2]")).alias("v")).first()
    assert v.t == "[0.50000000,-1.00000000]" and v.v == [0.1, 2.0]


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, props="": f"<w:p>{props}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Scope", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + p("Text") + '<w:p><w:r><w:br w:type="page"/></w:r></w:p>' + "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(t)}</w:tc>" for t in ("a", "a", "b")) + "</w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "broken.docx").write_bytes(b"PK broken")
    rows = docx.docx_blocks(files.raw_files(spark, str(tmp_path))).orderBy("path", "pos").collect()
    assert [(r.page, r.kind, r.text) for r in rows if r.kind != "error"] == [(1, "heading", "Scope"), (1, "body", "Text"), (2, "body", "a | b")]
    assert [r.kind for r in rows].count("error") == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "license\nplain"), (2, "erble !!")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    rows = ingest.assessed_stream(spark, str(tmp_path / "in"), pack=demo.OBLIGATIONS)
    for _ in range(2):  # the second run finds nothing new
        ingest.append(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "assessment", "severity")
    assert sorted(map(tuple, got.collect())) == [(1, "NON_TRANSFERABLE_REGULATION", "HIGH"), (1, "VALID", "LOW"), (2, "OPERATIONAL_RISK", "HIGH")]


def test_tenants_and_state(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "customer_id int, x string")
    assert [r.x for r in store.Tables({"t": rows}, 2)["t"].collect()] == ["b"]
    assert store.strip_internal(rows.withColumn("_y", F.lit(1))).columns == ["customer_id", "x"]


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"clauses": [{"clause_id": "c", "expected_matches": [{"sr_id": "s", "expected_match_type": "DIRECT_MATCH"}]}]}')
    (tmp_path / "bad.json").write_text("[1, 2")
    (tmp_path / "other.json").write_text('{"x": 1}')
    assert [tuple(r) for r in files.load_benchmark(spark, str(tmp_path / "good.json")).collect()] == [("c", "s", "DIRECT_MATCH")]
    assert all(files.load_benchmark(spark, str(tmp_path / n)) is None for n in ("bad.json", "other.json", "none.json"))


def test_nearest_by_brute_force(spark):
    import numpy as np

    from tessera.operators import matching

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).round(3).tolist()) for i in range(70)] + [(100, [0.0] * 5), (101, None), (102, [1.0, 2.0]), (103, rng.normal(size=5).tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = {}
    for r in matching.nearest(df.where("id % 10 = 0").selectExpr("id query_id", "v"), df.selectExpr("id item_id", "v"), k=4, block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.similarity))
    vectors = {i: np.array(v) for i, v in rows if v and len(v) == 5 and any(v)}
    for q in [i for i in vectors if i % 10 == 0]:
        score = sorted((-round(float(vectors[q] @ x / np.linalg.norm(x) / np.linalg.norm(vectors[q])), 4), i) for i, x in vectors.items())[:4]
        assert [(i, -s) for s, i in score] == [(i, s) for _, i, s in sorted(got[q])]
    assert 100 not in got


def test_items_contained_in_documents(spark):
    from tessera.operators import matching

    docs = [(1, "Here stands a whole long item, yes"), (2, "a whole\nlong item"), (3, "AWHOLE LONG ITEM"), (4, None), (5, "xy zw")]
    items = [(1, "a whole long item"), (2, "whole long"), (3, ""), (4, None), (5, "Y z"), (6, "xy")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(k, j) for k, t in docs for j, s in items if t and s and s.lower() in t.lower()}
    assert {tuple(r) for r in matching.contained(d, i).collect()} == want


def test_vectors_are_written_with_exact_rounding(spark):
    """Ties of the exact value go to the even digit, as the SQL's printf does; what only looks like a tie goes to its side."""
    r = random.Random(4)
    values = [0.001953125, -0.001953125, 0.005859375, 0.0, -0.0, -1e-9, 1.0, 12345.678, 1e7, 0.1, 3.0 / 512, 1e10] + [n / 512 for n in range(-40, 40)] + [r.uniform(-1, 1) for _ in range(2000)]
    floats = [struct.unpack("f", struct.pack("f", v))[0] for v in values]
    df = spark.createDataFrame([(floats,)], "v array<float>")
    assert df.select(models.vector_text(F.col("v")).alias("t")).first().t == "[" + ",".join("%.8f" % v for v in floats) + "]"
    odd = spark.createDataFrame([([float("nan"), float("inf"), float("-inf"), None, 2.5],), (None,)], "v array<float>")
    assert [x.t for x in odd.select(models.vector_text(F.col("v")).alias("t")).collect()] == ["[nan,inf,-inf,2.50000000]", None]


def test_reports_read_their_plan_once(spark):
    """The lines of a report come from one evaluation of its actions, not from one for each kind of line."""
    from tessera.operators import render

    count = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        count.add(1)
        return t

    plan = spark.createDataFrame([("s", "A", 1, "HIGH", 7.0, 9.0, 2, ["t"]), ("s", "B", 2, "LOW", 1.0, 1.0, 1, [])], "source string, finding_type string, action_no int, priority string, max_score double, total_score double, n_clauses int, topics array<string>")
    evidence = spark.createDataFrame([("s", "A", "R", "F", "DIRECT_MATCH", 90, "c", 1)], "source string, finding_type string, sr_id string, framework string, match_type string, confidence int, source_clause string, place int")
    text = render.action_report(plan.withColumn("priority", seen("priority")), evidence, "source").collect()[0].text
    assert count.value == 2 and "| R | F | DIRECT_MATCH | 90 | c |" in text and text.index("ACT-001") < text.index("ACT-002")
