"""Decontamination: short items, odd rows, several blocks of the benchmark, against a plain search."""

import random

from tessera.llm import decontamination as D


def plain(text, item):
    """Whether ``text`` holds ``item`` word for word."""
    a, b = D.tokens(text), D.tokens(item)
    return bool(b) and any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))


def test_short_items_and_odd_rows(spark):
    items = [(1, "three short words"), (2, "two words"), (3, "one"), (4, None), (5, ""), (None, "no id at all here"), (6, "five words stand right here"), (6, "five words stand right here")]
    docs = [(1, "it says: Three, short words!"), (2, "there are two words in it"), (3, "Two words."), (4, None), (5, ""), (6, "one"), (None, "three short words"), (7, "five words stand right, here"), (7, "words stand right here five"), (8, "x " * 300_000 + "three short words"), (9, "no id at all here")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' item_ids")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_ids) for r in D.decontaminate(rows, bench).collect())
    assert got == [(0, [1]), (1, [1]), (2, []), (3, [2]), (4, []), (5, []), (6, [3]), (7, []), (7, [6]), (8, [1]), (9, [])]
    kept = D.drop_contaminated(rows, bench)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7, 9]


def test_several_blocks(spark, monkeypatch):
    random.seed(3)
    words = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(random.choices(words, k=random.randint(10, 60)))) for k in range(60)]
    docs = [(k, " ".join([*random.choices(words, k=200), *(items[k][1].split() if k < 60 else []), *random.choices(words, k=100)])) for k in range(90)]
    monkeypatch.setattr(D, "BLOCK", 12)
    got = {r.doc_id: r.item_ids for r in D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all((k in got[d]) >= plain(t, items[k][1]) for d, t in docs for k in range(60)) and not any(got[d] for d in range(60, 90))


def test_groups_hold_all_words():
    random.seed(5)
    texts = [None, "", " ,. ", "a", "x" * 1_200_000, *(" ".join(random.choices(["ab", "c-d", "É", "f\n"], k=random.choice([3, 50, 400_000]))) for _ in range(6))]
    held = {}
    for g in D.grouped(texts):
        for i, a, z in g.cuts:
            held.setdefault(i, []).append([g.words(k, k + 1)[0] for k in range(a, z)] if z - a < 1000 else g.words(a, z))
            assert len(held[i][-1]) == z - a
    for i, t in enumerate(texts):
        want, parts = D.tokens(t), held.get(i, [])
        whole = parts[0][:] if parts else []
        for p in parts[1:]:  # each next cut begins two windows of words before the last one's end
            whole += p[2 * D.WINDOW :]
        assert whole == want
