"""The pipeline's near-dedup against the exact Jaccard similarity of every pair."""

import random
from itertools import combinations

import corpus_pipeline as P
from tessera.llm.common import table
from tessera.llm.near_copies import keep_one, near_copies


def slow_windows(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def slow_components(rows):
    sets = [(k, slow_windows(t)) for k, t in rows]
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
            p, q = sorted((find(i), find(j)))
            parent[q] = p
    return {k: find(k) for k in parent}


def test_links_are_exact_jaccard(spark):
    random.seed(3)
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    words = sorted({w for _, t in rows for w in (t or "").split()})
    long = [t.split() for _, t in rows if len((t or "").split()) >= 60]
    for k in range(300):  # copies from hardly changed to quite another text
        copy = list(random.choice(long))[:400]
        for i in range(len(copy)):
            if random.random() < (k % 10) / 100:
                copy[i] = random.choice(words)
        rows.append((10_000 + k, " ".join(copy)))
    base = random.choices(words, k=150)  # a group whose members are like the base and each other to a varying degree
    for k in range(80):
        copy = list(base)
        for i in random.sample(range(150), random.randint(0, 6)):
            copy[i] = random.choice(words)
        rows.append((20_000 + k, " ".join(copy)))
    rows += [(30_000, None), (30_001, ""), (30_002, "a b"), (30_003, "A  b"), (30_004, "a b c")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_components(rows)
    assert {r.doc_id: r.component_id for r in near_copies(made).collect()} == want
    assert {r.doc_id for r in P.drop_near_copies(spark, made, "").collect()} == set(want.values())


def test_rows_without_id_and_no_rows(spark):
    made = spark.createDataFrame([(None, "x y z"), (5, "x y z"), (2, "X y z"), (2, "x y z"), (None, "other")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_copies(made).collect()) == [(0, 0), (0, 2), (2, 2), (2, 2), (5, 2)]
    assert sorted(r.doc_id or 0 for r in P.drop_near_copies(spark, made, "").collect()) == [0, 0, 2]
    assert P.drop_near_copies(spark, made.where("false"), "").count() == 0


def test_keep_one_leaves_columns_with_helper_names_alone(spark):
    made = [(1, "some words of a text", "x", "y", "r"), (2, "some words of a text", "x", "y", "r"), (3, "quite another one", "x", "y", "r")]
    docs = spark.createDataFrame(made, "doc_id long, text string, _text_hash string, _hash string, root string")
    assert sorted(map(tuple, keep_one(docs).collect())) == [made[0], made[2]]
