"""Joins that look at candidates only, against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import literals as L
from tessera.operators import matching as M
from tessera.packs import CATALOGUE


@pytest.mark.parametrize(
    "pattern, parts",
    [
        ("encrypt(?:ion|ed)?", ["encrypt"]),
        ("data\\s+subject", ["subject"]),
        ("oder|aber", ["aber", "oder"]),
        ("wh.{0,3}ing", ["ing"]),
        ("(?:sub-?processor){1,2}", ["processor"]),
        ("a|bcd", None),
        ("x?yz*", None),
        ("[abc]def", ["def"]),
        ("(?i)Straße", ["strasse"]),
        ("(?:notify)?within \\d+ (?:hours|days)", ["within"]),
        ("(unclosed", None),
        ("", None),
    ],
)
def test_needed_parts(pattern, parts):
    got = L.needed_parts(pattern)
    assert (sorted(got) if got else None) == (parts and [x.upper() for x in parts])


def test_a_match_always_holds_a_needed_part():
    texts = ["Encryption of data subject requests, SUBPROCESSOR list", "Der Auftragnehmer oder aber die Straße", "within 72 hours notify the authority", "exit strategy; termination assistance"]
    for p in (p for r in CATALOGUE for p in r.patterns):
        parts = L.needed_parts(p)
        for t in texts:
            if parts and re.search(p, t, re.I):
                assert any(x in L._fold_text(t) for x in parts)


def test_run_time_patterns_equal_the_nested_loop(spark):
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma-ray", "straße", "DELTA", "x1", "über", "no", "éclair", "Kelvin", "ſtill"]
    texts = [(i, " ".join(r.choices(words, k=r.randint(0, 9)))) for i in range(120)] + [(200, None), (201, "")]
    patterns = [("a", "alp.a"), ("a", "beta|GAMMA"), ("b", "stra(ß|ss)e"), ("b", "\\bx1\\b"), ("c", "delta.*über"), ("c", "delta.*über"), ("d", "kelvin"), ("d", "still"), ("e", "é"), ("f", None), ("g", "[[:no")]
    patterns = [p for p in patterns if p[1] != "[[:no"]
    clauses = spark.createDataFrame([(*t, "s") for t in texts], "clause_id int, text string, sr_id string")
    table = spark.createDataFrame([(s, "F", None if p is None else "(?iu)" + p) for s, p in patterns], "sr_id string, framework string, pattern string")
    want = clauses.drop("sr_id").join(table, F.expr("text rlike pattern")).groupBy("clause_id", "sr_id").agg(F.count("*").alias("hits"))
    got = M.match_patterns_join(clauses.drop("sr_id"), table)
    key = lambda df: sorted((x.clause_id, x.sr_id, x.hits) for x in df.collect())
    assert key(got) == key(want) and len(key(got)) > 60
    assert M.match_patterns_join(clauses.drop("sr_id"), table.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [100_000, 5])
def test_bounded_search_equals_all_pairs(spark, crowd):
    r = random.Random(9)
    weights = lambda n, key: spark.createDataFrame([(i, f"t{t}", r.random() ** 3) for i in range(n) for t in {r.randint(0, 40) ** 2 // 40 for _ in range(8)}], f"{key} int, tok string, w double")
    queries, index = weights(60, "q").cache(), weights(40, "i").cache()
    dot = queries.join(index.withColumnRenamed("w", "w2"), "tok").groupBy("q", "i").agg(F.round(F.sum(F.col("w") * F.col("w2")), 4).alias("score")).where("score >= 0.4")
    want = {}
    for x in dot.collect():
        want.setdefault(x.q, []).append((-x.score, -x.i))
    got = {}
    for x in M.top_similar(queries, index, "q", "i", k=3, least=0.4, crowd=crowd).collect():
        got.setdefault(x.q, []).append((-x.score, -x.i))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:3] for k, v in want.items()}
    assert M.lifting(queries, index, "q", least=0.4).count() < queries.count()


@pytest.mark.parametrize("wide", [0, 5, 10_000])
def test_scores_add_up_by_joins(spark, wide):
    """Pairs do not carry both texts' weights; tokens that make no pairs of their own still count in the scores of found ones."""
    r = random.Random(3)
    weights = lambda n, key: spark.createDataFrame([(i, f"t{t}", r.random() ** 3) for i in range(n) for t in {r.randint(0, 40) ** 2 // 40 for _ in range(8)}] + [(None, "t0", 1.0)], f"{key} int, tok string, w double")
    queries, index = weights(60, "q").cache(), weights(40, "i").cache()
    dot = queries.join(index.withColumnRenamed("w", "w2"), "tok").where("q is not null and i is not null").groupBy("q", "i").agg(F.round(F.sum(F.col("w") * F.col("w2")), 4).alias("score")).where("score >= 0.4")
    got = M.top_similar(queries.where("q is not null"), index.where("i is not null"), "q", "i", k=100, least=0.4, wide=wide)
    assert sorted((x.q, x.i, x.score) for x in got.collect()) == sorted(map(tuple, dot.collect()))
    assert "map_from_entries" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("at_once", [1, 7, 128])
def test_neighbours_in_small_products_equal_brute_force(spark, at_once):
    """A worker holds the scores of ``at_once`` queries, not of a whole block; odd vectors are near to nothing."""
    r = random.Random(2)
    vectors = {i: [r.choice((-1.0, 0.5, 0.0, 2.0)) for _ in range(3 if i % 5 else 2)] for i in range(60)}
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([*vectors.items(), *odd], "item_id long, v array<float>")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    real = {i: v for i, v in vectors.items() if any(v)}
    want = {(q, i, n + 1) for q, a in real.items() for n, (_, i) in enumerate(sorted((-round(cosine(a, b), 4), i) for i, b in real.items() if len(a) == len(b))[:4])}
    got = M.nearest(df.withColumnRenamed("item_id", "query_id"), df, k=4, at_once=at_once)
    assert {(x.query_id, x.item_id, x["rank"]) for x in got.collect()} == want


ODD = ["Hello World_1 a über straße abc ABC", None, "", "x", "日本 語abc abc 😀abc", "ábc d́ef", "ab\0cd ef", " tail ", "İstanbul K Kelvin ﬁne ſo", "٣abc ab٣ ab-cd", "é" * 9 + " ab " + "𝒳ab ab𝒳 ②two", "no\nno\tno"]


def test_words_of_batches_are_those_of_the_regular_expression(spark):
    rows = spark.createDataFrame([*enumerate(ODD), (3, "ab x ab"), (None, "ab")], "k int, text string")
    words = M.token_rows(rows, "text", "k", stop_words=()).select("tok").distinct().where("tok <> 'no'").collect()
    known = spark.createDataFrame([(w.tok, len(w.tok) + 0.5) for w in words], "tok string, idf double")
    key = lambda df: sorted((r.k, r.tok, round(r.w, 12)) for r in df.collect())
    want = key(M.weights(M.token_rows(rows, "text", "k", stop_words=()), "k", known))
    assert key(M.text_weights(rows, "text", "k", known)) == want == key(M.text_weights(rows, "text", "k", known, held=0)) and len(want) >= 15
    assert "regexp_extract_all" not in M.text_weights(rows, "text", "k", known)._jdf.queryExecution().toString()
    assert M.text_weights(rows, "text", "k", known.where("false")).count() == 0


@pytest.mark.parametrize("k, cells", [(3, 1 << 21), (3, 7), (100, 50)])
def test_pairs_are_scored_where_the_query_lies(spark, k, cells):
    """No row for each token of each pair, and none for each pair: tasks give on what can be among a query's best."""
    r = random.Random(4)
    weights = lambda n, key: spark.createDataFrame([(i, f"t{t}", r.choice((0.25, 0.5, r.random()))) for i in range(n) for t in {r.randint(0, 40) ** 2 // 40 for _ in range(8)}], f"{key} int, tok string, w double")
    queries, index = weights(60, "q").cache(), weights(40, "i").cache()
    key = lambda df: sorted((x.q, x.i, x.score, x["rank"]) for x in df.collect())
    joined = M.top_similar(queries, index, "q", "i", k=k, least=0.4, held=0)
    got = M.top_similar(queries, index, "q", "i", k=k, least=0.4)
    assert key(got) == key(joined) and len(key(got)) > 100
    assert "Join" in joined._jdf.queryExecution().toString() and "Join" not in got._jdf.queryExecution().toString()
    scored = M._scored_in_tasks(queries, index, "q", "i", k=k, least=0.4, cells=cells)
    assert key(M._best(scored, "q", "i", k, 0.4)) == key(joined)
    assert k == 100 or scored.count() < queries.join(index.drop("w"), "tok").select("q", "i").distinct().count() / 2
    assert M.top_similar(queries, index.where("false"), "q", "i").count() == 0


def test_whole_items_are_found_where_texts_are_read(spark):
    r = random.Random(8)
    words = ["Alpha", "beta-ray", "über", "x1", "a", "日本", "no_way", "é", "…", "\n"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(200)] + [None, "", *[x for x in ODD if x]]
    items = [" ".join(r.choices(words, k=r.randint(1, 3))) for _ in range(40)] + [None, "", "pha b", "ay über x", "lpha BETA-ray a", "日本 a", "abc abc", "ab\0cd", "ab", "🚀"]
    d, i = spark.createDataFrame([*enumerate(texts), (None, "alpha")], "doc_id int, text string"), spark.createDataFrame([*enumerate(items)], "item_id int, text string")
    want = {(x.doc_id, x.item_id) for x in d.join(i.withColumnRenamed("text", "item"), F.expr("item <> '' and contains(lower(text), lower(item))")).collect()}
    got = M.contained(d, i)
    assert {tuple(x) for x in got.collect()} == want and len(want) > 100
    assert {tuple(x) for x in M.contained(d, i, held=0).where("doc_id is not null").collect()} == {x for x in want if x[0] is not None}
    assert "Join" not in got._jdf.queryExecution().toString()
    assert M.contained(d, i.where("false")).count() == 0
