"""Near-dedup, decontamination, sharding and packing against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tessera.llm import decontamination as D
from tessera.llm import packing, sharding, simhash
from tessera.llm.common import table
from tessera.llm.components import components

DATA = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    texts = [None, "", " ", "one", "One two", "a b c", "a b c a b c", "É x y z"] + [r.text for r in table(spark, DATA, "documents").limit(50).collect()]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


@pytest.fixture(scope="module")
def planted():
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << k for k in random.sample(range(64), random.randint(1, 5))) for b in base for _ in range(6)]
    chain = [base[0]]
    for _ in range(30):
        chain.append(chain[-1] ^ sum(1 << k for k in random.sample(range(64), 3)))
    return sorted({*base, *near, *chain, 0, 7, (1 << 64) - 1})


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("reach, parts", [(1, None), (3, None), (3, 3), (3, 2), (6, 4)])
def test_links_are_all_found(spark, planted, reach, parts):
    df = spark.createDataFrame([(signed(x),) for x in planted], "fp long").repartition(3)
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in combinations(planted, 2) if (a ^ b).bit_count() <= reach}
    assert {tuple(r) for r in simhash.links(df, reach, parts=parts).collect()} == want
    some = simhash.links(df, reach, parts=parts, forest=True)
    assert {tuple(r) for r in some.collect()} <= want
    roots = [{r.node: r.root for r in components(x).collect()} for x in (some, spark.createDataFrame(sorted(want), "a long, b long"))]
    assert roots[0] == roots[1]


def test_allocation_is_optimal():
    rng = np.random.default_rng(0)
    costs = np.cumsum(rng.random((20, 4, 5)), 2)
    got = simhash.allocate(costs, 3)
    assert (got.sum(1) == 0).all()
    from itertools import product

    for c, t in zip(costs, got):
        best = min(sum(c[i, k[i] + 1] for i in range(4)) for k in product(range(-1, 4), repeat=4) if sum(k) == 0)
        assert sum(c[i, t[i] + 1] for i in range(4)) == pytest.approx(best)


def test_ball_counts():
    counts = np.zeros(1 << 16)
    counts[[0, 1, 3, 7, 65535]] = [2, 1, 1, 4, 9]
    near = simhash.ball_counts(counts, 3)
    assert [round(near[d, 0]) for d in range(4)] == [2, 3, 4, 8] and round(near[2, 65534]) == 9


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(400, i) for i in range(401, 460)] + [(i, i + 1) for i in range(500, 620)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    got = components(spark.createDataFrame(edges, "a int, b int"))
    assert {r.node: r.root for r in got.collect()} == want and got.count() == len(want)
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_near_duplicates(spark):
    rows = [(10, "the same text of some length here"), (4, "the same text of some length here"), (None, "the same text of some length here"), (7, None), (8, ""), (None, "alone without id at all"), (9, "quite another text stands in this row"), (9, "quite another text stands in this row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' fingerprint", "1 component_id")
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    first = {0: None}
    least = defaultdict(list)
    for k, t in rows:
        least[slow_fingerprint(t)].append(k)
    want = Counter((k, f"{slow_fingerprint(t):016x}", min((x for x in least[slow_fingerprint(t)] if x is not None), default=first[0])) for k, t in rows)
    assert got == want
    kept = sorted((r.doc_id is None, r.doc_id) for r in simhash.keep_one(docs).collect() if r.doc_id is not None)
    assert [k for _, k in kept] == [4, 7, 9] and simhash.keep_one(docs).columns == docs.columns


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequence():
    random.seed(2)
    for _ in range(200):
        a, b = ([random.choice("abcd").encode() for _ in range(random.randint(1, 20))] for _ in range(2))
        assert D.common_subsequence(D.Passage._masks(a), len(a), b) == slow_lcs(a, b)


def test_planted_leaks(spark):
    random.seed(4)
    docs, items = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"), table(spark, DATA, "benchmark")
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 200").collect()}
    wanted, rows = set(), []
    for r in items.collect():
        words = r.text.split()
        if len(words) < 12:
            continue
        for i in range(0, len(words) - 6, 9):  # a paraphrase: every ninth word replaced
            words[i] = "other"
        host = texts[r.item_id].split()
        at = random.randrange(len(host) + 1)
        rows.append((10_000 + r.item_id, " ".join(host[:at] + words + host[at:])))
        wanted.add(10_000 + r.item_id)
    odd = [(20_000, None), (20_001, ""), (None, "text without an id"), (20_002, "word " * 50_000)]
    part = spark.createDataFrame([*texts.items(), *rows, *odd], "doc_id long, text string").selectExpr("*", "1 contaminated", "2 item_ids")
    got = D.decontaminate(part, items).collect()
    found = {r.doc_id for r in got if r.contaminated}
    assert len(got) == part.count()
    assert len(found & wanted) >= 0.9 * len(wanted)
    # brute force: every window of every text, every passage
    passages = [D.Passage(r.item_id, p) for r in items.collect() for p in D.passages(D.tokens(r.text)) if p]
    exact = set()
    for k, t in [*texts.items(), *rows]:
        w = D.tokens(t)
        for p in passages:
            if len(p.words) >= 8 and any(p.match(w[max(0, h - 16) : h + 64], sure=0.75, wording=0.6, answer=0.6) for h in range(0, len(w), 16)):
                exact.add(k)
                break
    assert found <= exact and len(found) >= 0.9 * len(exact)
    assert not any(r.contaminated for r in D.decontaminate(part.limit(30), items.where("false")).collect())
    assert D.drop_contaminated(part, items).columns == part.columns
    assert D.decontaminate(part.where("false"), items).count() == 0


def test_shards(spark):
    random.seed(6)
    rows = [(i, "w" * random.randint(0, 400)) for i in range(4000)] + [(5000 + i, "the hot text " * 5) for i in range(2500)] + [(None, None), (None, "x"), (1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 shard", "'q' size")
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    load = defaultdict(int)
    slots = defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(8)) and max(load.values()) < 1.03 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((k, len((t or "").encode()) + 1) for k, t in rows)
    assert sharding.shard_documents(docs.where("false")).count() == 0
    assert len({r.shard for r in sharding.shard_documents(docs.limit(3)).collect()}) <= 3


def test_boundaries_are_optimal():
    random.seed(7)
    for _ in range(30):
        lengths = sorted(random.sample(range(1, 60), random.randint(1, 8)))
        counts = [random.randint(1, 9) for _ in lengths]
        k = random.randint(1, 4)
        cost = lambda ends: sum(c * (min(e for e in ends if e >= v) - v) for v, c in zip(lengths, counts))  # noqa: B023, E731
        best = min(cost((*c, lengths[-1])) for j in range(min(k, len(lengths))) for c in combinations(lengths[:-1], j))
        got = packing.optimal_boundaries(lengths, counts, k)
        assert got[-1] == lengths[-1] and len(got) <= k and cost(got) == best


def test_batches(spark):
    random.seed(8)
    rows = [(i, random.choice([3, 3, 3, 50, random.randint(0, 3000), 90_000 if i % 500 == 0 else 7])) for i in range(3000)] + [(None, None), (1, 5), (1, 5)]
    lengths = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "1 bucket", "'z' batch")
    got = packing.pack(lengths, buckets=6, budget=8192, block_rows=500).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((k, n or 0) for k, n in rows)
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket_length
        batches[r.bucket, r.batch].append(r)
    for (b, k), held in batches.items():
        per = max(1, 8192 // max(1, held[0].bucket_length))
        assert sorted(r.slot for r in held) == list(range(len(held))) and len(held) <= per
        assert len(held) == per or (b, k + 1) not in batches
    assert packing.pack(lengths.where("false")).count() == 0


def test_large_component(spark):
    """A component of half of all fingerprints, beside small ones."""
    random.seed(9)
    centre = random.getrandbits(64)
    hot = [centre ^ (1 << k) for k in range(64)] + [centre ^ (1 << k) ^ (1 << j) for k, j in combinations(range(20), 2)]
    cold = [random.getrandbits(64) for _ in range(200)]
    docs = spark.createDataFrame([(i, str(i)) for i in range(len(hot) + len(cold))], "doc_id long, text string")
    made = {str(i): x for i, x in enumerate(hot + cold)}
    real, simhash.fingerprints = simhash.fingerprints, lambda d, s: spark.createDataFrame([(int(k), signed(x)) for k, x in made.items()], "doc_id long, fp long")
    try:
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    finally:
        simhash.fingerprints = real
    assert all(got[i] == 0 for i in range(len(hot))) and all(got[i] == i for i in range(len(hot), len(made)))
