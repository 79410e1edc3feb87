"""Operators 11 to 13 against brute force, with odd rows."""

import hashlib
import itertools
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import order_minhash as M
from tessera.llm.common import stored
from tessera.llm.hard_negatives import hard_negatives
from tessera.llm.token_alignment import Aligner, align, components, default_tokenizers, with_link_counts

DATA = "/root/testdata/sf0.001"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# ---- 11 ----------------------------------------------------------------------


def brute_negatives(rows, is_anchor, k=5):
    fit = {(i, y, tuple(int(256 * x // 1) for x in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)}
    out = set()
    for a in sorted(x for x in fit if is_anchor(x[0])):
        scores = {(-sum(p * q for p, q in zip(a[2], r[2])), r[0], r[1] == a[1]) for r in fit if len(r[2]) == len(a[2])}
        for s, p, _ in sorted({(s, i, y) for s, i, y in scores if y and i != a[0]})[:k]:
            near = sorted((t, n) for t, n, y in scores if not y and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out |= {(a[0], p, j, n, -s, -t) for j, (t, n) in enumerate(near, 1)}
    return sorted(out)


@pytest.mark.parametrize("block, piece", [(16_384, 65_536), (3, 37)])
def test_hard_negatives_equal_brute_force(spark, block, piece):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    data = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    got = hard_negatives(df, F.col("vec_id") % 100 == 0, anchor_block=block, rows_block=piece)
    want = brute_negatives(data, lambda i: i % 100 == 0)
    assert len(want) > 50
    assert rows_of(got, *NAMES) == want


def test_hard_negatives_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, 1, [1.0, 2.0]), (100, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 2, [1.0, 1.9]), (2, 2, [1.0, 1.9]), (2, 3, [1.0, 1.9]), (3, 2, [1.0, 2.0]), (4, 2, [0.9, 1.7]), (5, None, [1.0, 2.0])]
    data += [(None, 2, [1.0, 2.0]), (6, 2, None), (7, 2, [1.0, None]), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (10, 2, [1.0, 2.0, 3.0]), (11, 2, []), (200, 9, [-1.0, -1.0]), (201, 9, [1.0, 1.0]), (300, 4, [2e9, 2e9]), (301, 4, [2e9, 1e9]), (302, 5, [2e9, 1e9])]
    df = spark.createDataFrame([(*d, 7, "x") for d in data], "vec_id long, label int, embedding array<double>, score long, place string")
    got = hard_negatives(df, F.col("vec_id") % 100 == 0, anchor_block=2, rows_block=4)
    want = [r for r in brute_negatives(data, lambda i: i % 100 == 0)]
    fits = [r for r in want if abs(r[4]) < 1 << 63 and abs(r[5]) < 1 << 63]
    assert [r for r in rows_of(got, *NAMES) if r[0] != 300] == [r for r in fits if r[0] != 300] and fits
    empty = hard_negatives(df.where("vec_id < -1"), F.col("vec_id") % 100 == 0)
    assert empty.count() == 0 and tuple(empty.columns) == NAMES
    assert hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_a_hot_label_keeps_all_its_rows(spark):
    rows = spark.range(3000).selectExpr("id as vec_id", "if(id % 3 = 0, 1, 2) as label", "array(double(id % 50) / 50, 1d) as embedding")
    data = [(r.vec_id, r.label, r.embedding) for r in rows.collect()]
    got = hard_negatives(rows, F.col("vec_id") % 500 == 0, rows_block=256)
    assert rows_of(got, *NAMES) == brute_negatives(data, lambda i: i % 500 == 0)


# ---- 12 ----------------------------------------------------------------------


def brute_alignment(data):
    its, found = Aligner(*default_tokenizers()), []
    for key, t in data:
        a, b = (its.a.encode(" " + t, add_special_tokens=False).ids, its.b.encode(t)) if t else ([], [])
        x, y = [its.a_bytes[i] for i in a], [its.b_bytes[i] for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            found.append((key, 0, 0, [], []))
            continue
        p, q = (dict(zip(itertools.accumulate(map(len, z)), itertools.count())) for z in (x, y))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(p.keys() & q.keys()):
            groups.append(",".join(map(str, a[i : p[end] + 1])) + "|" + ",".join(map(str, b[j : q[end] + 1])))
            links.append((a[p[end]], b[q[end]]))
            i, j = p[end] + 1, q[end] + 1
        found.append((key, len(a), len(b), groups, links))
    counts = Counter(x for f in found for x in f[4])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(k, na, nb, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), sha(g)) for k, na, nb, g, ls in found]


def alignment(df, **how):
    g = F.col("groups")
    out = with_link_counts(align(df).withColumn("groups_sha256", F.when(g == "", "").otherwise(F.sha2(g, 256))).drop("groups"), **how)
    order = lambda r: tuple((x is not None, x) for x in r)
    return sorted([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()], key=order), order


@pytest.mark.parametrize("entries", [1 << 20, 300, 0])
def test_alignment_equals_brute_force(spark, entries):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got, order = alignment(df, table_entries=entries)
    assert got == sorted(brute_alignment([(r.doc_id, r.text) for r in df.collect()]), key=order)


def test_alignment_of_odd_texts(spark):
    texts = ["", None, " ", "  lead", "trail  ", "a\n b", "tab\there", "x▁y", "<|endoftext|> and <s> <0x41>", "日本語 🎉 é é", "\x00 \x1f a", "same text", "same text", "n" * 5000, "word " * 3000, "　a\xa0b \xa0 \xa0 c", "'s can't we'll", "¡ña 12345 6 7,8.9"]
    df = spark.createDataFrame([(None if i == 3 else i % 16, t, 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, pairs string")
    got, order = alignment(df, table_entries=5)
    assert got == sorted(brute_alignment([(None if i == 3 else i % 16, t) for i, t in enumerate(texts)]), key=order)
    assert alignment(df.where("doc_id < 0"))[0] == []


def test_components_are_minimal_groups():
    a, b = components([3, 5, 9, 10, 12], [2, 5, 6, 7, 12])
    assert list(a) == [0, 0, 1, 1, 1] and list(b) == [0, 0, 1, 1, 1]
    a, b = components([1, 2, 3], [1, 2, 3])
    assert list(a) == list(b) == [0, 1, 2]
    ends = list(range(2, 402, 2))
    a, b = components(ends, [1, *range(3, 400, 2), 400])  # one chain through all tokens
    assert set(a) == set(b) == {0}


# ---- 13 ----------------------------------------------------------------------


def _hash(parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p, seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_fingerprint(text):
    units = [w[i : i + 4] for w in (text or "").translate(dict.fromkeys([*range(9, 14)], " ")).split(" ") if w for i in range(0, len(w), 4)]
    if not units:
        return [0] * 64
    kmers = [_hash([x.encode() for x in units[i : i + 2]]) for i in range(len(units))]
    seen, elements = Counter(), []
    for place, h in enumerate(kmers, 1):
        seen[h >> 24] += 1
        e = _hash([struct.pack("<q", h >> 24), struct.pack("<i", seen[h >> 24])])
        elements.append((e >> 24 << 24) | place)
    elements.sort()
    out = []
    for i in range(-32, 32):
        begin = sum(e < i << 58 for e in elements)
        taken = (elements + elements[:2])[begin : begin + 2]
        out.append(_hash([struct.pack("<q", kmers[p - 1]) for p in sorted(e & 0xFFFFFF for e in taken)]) & 0xFFFF)
    return out


def brute_marks(data):
    """data: (doc_id, text) without repeated keys or nulls."""
    data = sorted((k, t or "") for k, t in data)
    out = []
    for i, (k, t) in enumerate(data):
        after, h = data[(i + 1) % len(data)][1], len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        f, e, n = map(brute_fingerprint, (t, edited, after))
        same = lambda x, y: sum(p == q for p, q in zip(x, y)) / 64
        out.append((k, len(t), edited, tuple(f), tuple(e), same(f, e), same(f, n)))
    return out


def marks(df):
    got = M.with_next(stored(M.with_edits(df), "marked"))
    return [(r.doc_id, r.n_chars, r.edited, tuple(r.fingerprint), tuple(r.edited_fingerprint), r.near_edited, r.near_next) for r in got.collect()]


def test_fingerprints_equal_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    assert sorted(marks(df)) == brute_marks([(r.doc_id, r.text) for r in df.collect()])


def test_fingerprints_of_odd_texts(spark):
    texts = ["", None, " \n\t ", "a", "a a a a a a a a", "日本語🎉 ééé", "x" * 3000, "one two", "two one", "same words here again", "same words here again", "b c " * 4000]
    df = spark.createDataFrame([(i * 10, t, 3, "z") for i, t in enumerate(texts)], "doc_id long, text string, n int, _hash string")
    assert sorted(marks(df)) == brute_marks([(i * 10, t) for i, t in enumerate(texts)])
    assert marks(df.where("doc_id < 0")) == []
    (one,) = marks(df.where("doc_id = 70"))
    assert one[2] == "one " + "one" and one[6] == 1.0


def test_repeated_rows_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(M, "CROWD", 3)
    data = [(5, "the hot row of all")] * 40 + [(5, "another text under it")] * 2 + [(1, "first text"), (None, "no key"), (None, "no key"), (7, None)]
    got = marks(spark.createDataFrame(data, "doc_id long, text string").repartition(4))
    assert len(got) == len(data)
    by = {}
    for r in got:
        by.setdefault((r[0], r[2]), []).append(r)
    hot = [r for r in got if r[0] == 5]
    order = sorted({"the hot row of all", "another text under it"}, key=lambda t: _hash([t.encode()]))
    ring = [(1, "first text"), *((5, t) for t in order), (7, ""), (None, "no key")]
    want = Counter()
    for i, (k, t) in enumerate(ring):
        after, h = ring[(i + 1) % len(ring)][1], len(t) // 2
        want[k, t[: len(t) - h] + after[:h]] += sum(d == (k, t or None) for d in data)
    assert Counter((r[0], r[2]) for r in got) == want and len(hot) == 42


def test_likeness_falls_with_edits_and_knows_order(spark):
    words = [f"word{i}" for i in range(400)]
    texts = {0: words, 1: words[:360] + [f"new{i}" for i in range(40)], 2: words[:200] + [f"new{i}" for i in range(200)], 3: [f"other{i}" for i in range(400)], 4: [w for i in range(0, 400, 4) for w in words[396 - i : 400 - i]]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k int, t string").select("k", M.fingerprint(F.col("t")).alias("f"))
    f = {r.k: r.f for r in df.collect()}
    near = [sum(a == b for a, b in zip(f[0], f[k])) / 64 for k in range(5)]
    assert near[0] == 1.0 > near[1] > near[2] > near[3] and near[3] == 0.0
    assert near[4] < 0.7  # the same runs of words for the most part, in another order


def test_fingerprints_use_no_python(spark):
    df = M.with_edits(spark.read.parquet(f"{DATA}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))
