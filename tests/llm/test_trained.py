"""Toxicity, compression classifier, rules and language model: invariants, held-out accuracy, odd rows."""

import math
import random
import zlib
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest

from tessera.llm import hmm_lm, quality_rules
from tessera.llm.common import table
from tessera.llm.compression_quality import quality
from tessera.llm.quality_rules import measures, upper_bound
from tessera.llm.toxicity import Lexicon, drop_toxic, fold, toxicity

DATA = "/root/testdata/sf0.01"
ODD = "(-1, null, 'zz'), (-2, '', 'zz'), (null, 'no id', 'zz'), (-3, repeat('very long ', 40000), 'zz'), (-4, 'same', 'zz'), (-4, 'same', 'zz')"


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.sql(f"select * from values {ODD} as t(doc_id, text, score)")
    return table(spark, DATA, "documents").selectExpr("doc_id", "text", "'x' as score").unionByName(odd.selectExpr("cast(doc_id as long) doc_id", "text", "score"))


def held_out(k):
    return k is not None and zlib.crc32(str(k).encode()) % 5 == 0


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, docs, operator, label):
    labels = table(spark, DATA, "labels")
    rows = operator(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    seen = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, y, _ in seen if y], [s for s, y, _ in seen if not y]
    better = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert better > 0.8
    assert operator(docs.where("false"), labels).count() == 0
    assert len({r.score for r in operator(docs.limit(20), labels.where("false")).collect()}) == 1


def test_fold():
    assert fold("Ιdiоt") == fold("idiot") and fold("1D10T").strip() == "idiot" and fold("clówn!").split() == ["ciown"]
    assert fold("b@d !d!ot, $tupid cl|own").split() == ["bad", "idiot", "stupid", "ciiown"]
    assert fold("OK!! NO! a | b, c@d.e $5").split() == ["ok", "no", "a", "b", "cad", "e", "s"]
    assert fold(None) == "  " and fold("i\u200bdi\u00adot").split() == ["idiot"]


def test_every_lookalike_folds():
    from tessera.llm import toxicity as T

    assert all(len(k) == len(v) == 1 for k, v in (T._CAPITALS | T._LOOKALIKES).items())
    for k, v in (T._CAPITALS | T._LOOKALIKES).items():
        assert fold(f"x{k}x") == fold(f"x{v}x"), k
    assert fold("КІЅЅ МΟΤΗ вут") == fold("KISS MOTH byt")


def slow_measure(lexicon, text):
    """Weight and hits by looking at every entry at every word, and the words of the folded text."""
    words = fold(text).split()
    free = set()
    for p in lexicon.exceptions:
        q = fold(p).split()
        free |= {i + k for i in range(len(words)) if words[i : i + len(q)] == q for k in range(len(q))}
    found = [x for i, w in enumerate(words) if i not in free for e, x in [*((e, x) for e, x in lexicon.whole.items() if e == w), *((e, x) for e, x in lexicon.starts.items() if w.startswith(e))]]
    return sum(found), len(found), len(words)


def test_matches_by_brute_force(docs):
    random.seed(8)
    lexicon = Lexicon({"ciown": 3.0, "ab": 1.5}, {"idio": 2.0, "ida": 0.5}, ("clown fish", "ab ab"))
    parts = ["clown", "cl0wn", "fish", "idiot", "IDIOTIC", "ab", "idaho", "id", "Іdіоt", "x", ".", "\n", "!!", "clówn"]
    for t in [" ".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(400)]:
        got, want = lexicon.matcher()(t), slow_measure(lexicon, " ".join(fold(t).split()))
        assert (got[0], got[1]) == want[:2] and (not got[1] or got[3] == want[2]), t


def test_padding_does_not_hide_words():
    measure = Lexicon({"idiot": 3.0}).matcher()
    plain = measure("you idiot")
    assert plain[3] == 2 and measure("you idiot " + ". " * 500) == plain and measure("\n\n" * 300 + "you   idiot") == plain


def test_lexicon_phrases():
    lexicon = Lexicon({"ciown": 3.0}, {"idio": 2.0}, ("clown fish",))
    assert lexicon.matcher()("A clown fish, an idiotic cl0wn.")[:3] == (5.0, 2, 2)
    assert Lexicon(exceptions=()).matcher()("anything")[0] == 0


def test_drop_toxic_keeps_columns(spark, docs):
    kept = drop_toxic(docs, table(spark, DATA, "labels"))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def brute(text):
    text = text or ""
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", text)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if x.strip("\x20\x09\x0a\x0b\x0c\x0d"):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_measures_by_brute_force(docs):
    random.seed(3)
    made = [" ".join(random.choice("ab") for _ in range(random.randint(0, 40))) + random.choice(["", "\n", "\nab\nab\n \n"]) for _ in range(300)]
    for t in [*made, *(r.text for r in docs.limit(300).collect()), None, "", "  x\x1cy"]:
        assert measures(t)[:5] == brute(t)


def test_exact_bound():
    p = upper_bound(3, 500, 0.01)
    assert abs(sum(math.comb(500, i) * p**i * (1 - p) ** (500 - i) for i in range(4)) - 0.01) < 1e-6
    assert upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert NormalDist().cdf(0) == 0.5


def test_paths_are_nested_and_tested_in_order():
    rng = np.random.default_rng(0)
    counts = Counter()
    for y, n, top in ((1, 6000, 200), (0, 900, 1000)):
        for r in (0, 3):
            for v in rng.integers(0, top, n):
                counts[r, y, int(-(-v // 20) * 20)] += 1
    path = quality_rules.path_of(counts, 3.0)
    assert path[0] == {0: 200, 3: 200} and all(set(a) <= set(b) and all(b[r] <= a[r] for r in a) for a, b in zip(path, path[1:]))
    steps = lambda lost, good: quality_rules.allowed_steps(lost, good, false_rejection=0.02, error=0.0125)
    assert steps([0, 0, 1, 30, 2], 1000) == 3 and steps([0], 216) == 0 and steps([0], 217) == 1 and steps([0], 0) == 0
    assert quality_rules.strata_of({0: 5, 1: 300, 2: 220, 3: 10}, 217) == ((0, 1), (2, 3)) and quality_rules.strata_of({1: 3}, 217) == ((0, 1, 2, 3),)


def test_false_rejection_is_limited_in_simulation():
    """In no more than the error level of many draws does an allowed step reject more good documents than allowed."""
    rng, broken, used = np.random.default_rng(4), 0, 0
    true = np.array([0.001, 0.008, 0.015, 0.021, 0.03])  # shares of good documents that the steps of a path really reject
    for _ in range(2000):
        at = np.searchsorted(true, rng.random(1500))
        lost = [int((at <= k).sum()) for k in range(len(true))]
        n = quality_rules.allowed_steps(lost, 1500, false_rejection=0.02, error=0.05)
        used += n > 0
        broken += n > 3
    assert broken <= 0.05 * 2000 and used > 1900


def test_verdicts_by_brute_force(spark):
    """At a size with enough labels cutoffs are chosen; every verdict follows from them, few good documents go and most bad ones."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rules = quality_rules.fit_rules(quality_rules.measured(docs), labels)
    assert rules.cutoffs
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).collect()}
    figures = {r.doc_id: (measures(r.text), y) for r, y in ((r, r.quality) for r in docs.join(labels, "doc_id", "left").select("doc_id", "text", "quality").collect())}
    for k, (m, _) in figures.items():
        over = any(m[5 + r] > c for (b, r), c in rules.cutoffs.items() if b == sum(m[0] >= x for x in (50, 200, 1000)))
        assert kept[k] == (m[0] >= 10 and 100 * m[4] <= 20 * m[0] and not over)
    good = [kept[k] for k, (m, y) in figures.items() if y == 1 and not quality_rules.base_failed(m[0], m[4])]
    bad = [kept[k] for k, (m, y) in figures.items() if y == 0 and not quality_rules.base_failed(m[0], m[4])]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)
    plan = quality_rules.drop_by_rules(docs, labels)
    assert {r.doc_id for r in plan.select("doc_id").collect()} == {k for k, v in kept.items() if v}
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_rules_query(spark, docs):
    rows = quality_rules.quality_rules(docs, table(spark, DATA, "labels")).collect()
    texts = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == texts
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    hmm = hmm_lm.HMM.from_counts(rng.random(3), rng.random((3, 3)), rng.random((5, 3)), np.ones(5) / 5, 1.0)
    from itertools import product

    for obs in ([0], [1, 4, 2], [3, 3, 0, 1]):
        total = 0.0
        for path in product(range(3), repeat=len(obs)):
            p = hmm.start[path[0]] * hmm.emit[obs[0], path[0]]
            for a, b, o in zip(path, path[1:], obs[1:]):
                p *= hmm.move[a, b] * hmm.emit[o, b]
            total += p
        assert hmm.log10([np.array(obs), np.array([2])])[0] == pytest.approx(math.log10(total))
    assert np.allclose(hmm.emit.sum(0), 1) and np.allclose(hmm.move.sum(1), 1)


def test_baum_welch_never_gets_worse():
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 6, rng.integers(1, 60)) for _ in range(50)]
    grid, first = hmm_lm.segments_of(np.concatenate(sequences), np.array(list(map(len, sequences))))
    assert [len(s) for s in np.split(grid, np.flatnonzero(first)[1:])] == [-(-len(s) // hmm_lm.SEGMENT) for s in sequences]
    hmm = hmm_lm.HMM.from_counts(rng.random(2), rng.random((2, 2)), rng.random((6, 2)), np.ones(6) / 6, 1e-9)
    before = -1e9
    for _ in range(8):
        start, move, emit = hmm.expected(grid, first)
        assert emit.sum() == pytest.approx(sum(map(len, sequences)))
        now = hmm.log10(sequences).sum()
        assert now >= before - 0.5  # the smoothing of starts and moves may cost a little
        before, hmm = now, hmm_lm.HMM.from_counts(start, move, emit, np.ones(6) / 6, 1e-9)


def test_symbols_are_those_of_single_words():
    own = [b"the", b"a", b"\xc3\xa9t\xc3\xa9"]
    s = hmm_lm.Symbols(own, 7)
    texts = ["The a x  yz", None, "", "été\tabcd\nA", " the"]
    flat, lengths = s.of(texts)
    want = [[own.index(w) if w in own else 3 + hmm_lm.suffix_symbol(w, 7) for w in hmm_lm.words_of(t)] + [s.end] for t in texts]
    assert flat.tolist() == [x for w in want for x in w] and lengths.tolist() == list(map(len, want))


def test_frequent_words_are_the_commonest(spark):
    random.seed(6)
    n = {f"w{i}".encode(): random.choice([1, 2, 3, 10, 500, 100_000 + i]) for i in range(400)}
    counts = spark.createDataFrame([(bytearray(w), k) for w, k in n.items()], "word binary, n long")
    got = hmm_lm.frequent_words(counts, 200)
    assert 0 < len(got) <= 200 and all(n[w] == k for w, k in got.items()) and list(got.values()) == sorted(got.values(), reverse=True)
    assert min(got.values()) > max(k for w, k in n.items() if w not in got)
    assert hmm_lm.frequent_words(counts, 400) == dict(sorted(n.items(), key=lambda x: (-x[1], x[0]))) and hmm_lm.frequent_words(counts.where("false"), 5) == {}


def test_scores_against_brute_force(spark, docs):
    part = docs.where("doc_id < 120 or doc_id is null")
    rows = hmm_lm.score_documents(part, states=3, own=50, frequent=80, suffixes=16, passes=1, sample_segments=500).collect()
    texts = part.collect()
    n = Counter()
    for r in texts:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            n.update([*(r.text or "").encode().lower().split(), None])
    total, types = sum(n.values()), len(n)
    want = Counter()
    for r in texts:
        words = [*(r.text or "").encode().lower().split(), None]
        want[r.doc_id, len(words), sum(n[w] > 0 for w in words), total, round(sum(math.log10((n[w] + 1) / (total + types + 1)) for w in words), 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    ours = [r for r in rows if r.n_tokens > 20]
    assert sum(r.score for r in ours) > sum(r.base_score for r in ours)


def test_empty_tables(spark, docs):
    none, labels = docs.where("false"), table(spark, DATA, "labels")
    assert hmm_lm.score_documents(none, passes=1).count() == 0
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert quality_rules.drop_by_rules(none, labels).columns == docs.columns
    untrained = docs.where("doc_id = -4")  # too few rows to learn from
    assert hmm_lm.score_documents(untrained, passes=1).count() == 2


def test_a_callers_entries_are_folded_as_texts_are():
    measure = Lexicon({"fool": 3.0, "l33t": 1.0, "Bad1": 2.0, "": 9.0, "???": 9.0}, {"Idiot": 4.0}, ("April Fool",)).matcher()
    for text, weight in (("what a fool", 3.0), ("F00L!", 3.0), ("leet", 1.0), ("bad1 bad1", 4.0), ("1d10tic", 4.0), ("an April fool", 0.0), ("foolish", 0.0), ("", 0.0)):
        assert measure(text)[0] == weight, text


def test_toxicity_does_not_depend_on_the_partitioning(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    scores = [sorted((r.doc_id, round(r.score, 12)) for r in toxicity(docs.repartition(n), labels).collect()) for n in (3, 7)]
    assert scores[0] == scores[1]


def test_copies_of_a_text_reach_the_driver_once(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'one boilerplate text of a few words' as text").unionByName(spark.range(50).selectExpr("id + 50000", "concat('other text ', id)").toDF("doc_id", "text"))
    sent, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: sent.append(got := collect(self)) or got)
    scored = hmm_lm.score_documents(docs)
    assert max(map(len, sent)) < 1000
    monkeypatch.undo()
    assert scored.where("score is null or isnan(score)").count() == 0 and scored.count() == 20_050


def test_language_model_learns_nothing_from_a_sample(spark, docs):
    part = docs.where("doc_id is not null")
    options = dict(states=3, own=50, frequent=80, suffixes=16, passes=1)
    scores = [sorted((r.doc_id, round(r.score, 6)) for r in hmm_lm.score_documents(part.repartition(n), sample_segments=sample, **options).collect()) for n, sample in ((3, 1), (5, 500))]
    assert scores[0] == scores[1]


def test_neighbours_are_counted_over_all_texts(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "_CHARS", 40)
    random.seed(12)
    texts = [" ".join(random.choices(["the", "a", "cat", "dogs", "été", "x1"], k=random.randint(0, 9))) for _ in range(60)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = hmm_lm.Model([b"the", b"a"], 7, {b"the": 3, b"a": 2}, np.ones(7), 10, 5, 62)
    symbols = model.symbols()
    classes, want = hmm_lm._classes(symbols), np.zeros((symbols.size, 2 * hmm_lm._SIDE))
    assert classes.max() == classes[symbols.end] < hmm_lm._SIDE and sum(classes == classes[symbols.end]) == 1
    for t in texts:
        flat = [symbols.end, *symbols.of([t])[0].tolist()]
        for a, b in zip(flat, flat[1:]):
            want[b, classes[a]] += 1
        for a, b in zip(flat[1:], flat[2:]):
            want[a, hmm_lm._SIDE + classes[b]] += 1
    assert np.array_equal(hmm_lm.neighbours(rows, model), want)
    assert not hmm_lm.neighbours(rows.where("false"), model).any()
