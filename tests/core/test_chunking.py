"""Chunks by pointer doubling against the loop that they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as C


def loop(units, target, most, overlap):
    """units: (pos, text, tokens) of one key, none over ``most``: the chunks one after the other."""
    out, begin, end = [], 0, -1
    while end < len(units) - 1:
        if end >= 0:  # the last whole units of up to ``overlap`` tokens, one at least, if they leave room for the next one
            begin = end
            while begin > 0 and sum(u[2] for u in units[begin - 1 : end + 1]) <= overlap:
                begin -= 1
            if sum(u[2] for u in units[begin : end + 2]) > most:
                begin = end + 1
        held, last = sum(u[2] for u in units[begin : end + 1]), end
        while last < len(units) - 1:
            t = units[last + 1][2]
            if last > end and held + t > most:
                break
            held, last = held + t, last + 1
            if held > target:
                break
        end = last
        out.append((units[begin][0], units[end][0], held, "\n".join(u[1] for u in units[begin : end + 1])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_chunks_equal_the_loop(spark, seed):
    r = random.Random(seed)
    docs = {d: [r.choice([1, 3, 8, 20, 45, 60]) if d % 3 else r.randint(1, 7) for _ in range(r.choice([1, 2, 5, 40, 300]))] for d in range(12)}
    rows = [(d, i, " ".join(f"w{i}.{j}" for j in range(n)), "x") for d, ns in docs.items() for i, n in enumerate(ns)]
    got = {}
    for c in C.chunks(spark.createDataFrame(rows, "d int, p int, line string, text string"), "d", "p", "line", target=40, most=60, overlap=9).collect():
        got.setdefault(c.d, []).append((c.chunk, (c.first_pos, c.last_pos, c.n_tokens, c.text)))
    for d, ns in docs.items():
        units = [(p, t, n) for (x, p, t, _), n in zip([q for q in rows if q[0] == d], ns)]
        want = loop(units, 40, 60, 9)
        assert sorted(got[d]) == list(enumerate(want))


def test_long_rows_are_cut_by_sentences_then_by_words(spark):
    text = "One two three. Four five six seven eight nine ten eleven twelve thirteen. " + "x " * 25
    rows = spark.createDataFrame([(1, 0, text), (1, 1, None), (1, 2, "  "), (1, 3, "end here"), (None, 0, "lost"), (2, 0, "")], "d int, p int, t string")
    units = [(u.text, u.t) for u in C.units(rows, "d", "p", "t", most=10).orderBy("d", "i").collect() if u.d]
    assert units == [("One two three.", 3), ("Four five six seven eight nine ten eleven twelve thirteen.", 10), ("x " * 9 + "x", 10), ("x " * 9 + "x", 10), ("x " * 4 + "x", 5), ("end here", 2)]
    got = C.chunks(rows, "d", "p", "t", target=8, most=10, overlap=2).orderBy("chunk").collect()
    assert [(c.first_pos, c.last_pos, c.n_tokens, c.text) for c in got] == loop([(3 if t == "end here" else 0, t, n) for t, n in units], 8, 10, 2)
    assert C.chunks(rows.where("d > 5"), "d", "p", "t").count() == 0


def test_chunks_by_subwords(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    lines = ["Übermäßige words of a contract, nº " + str(i) * (i % 9) for i in range(60)]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "d int, p int, t string")
    got = C.chunks(rows, "d", "p", "t", target=80, most=100, overlap=25, tokens=C.Subwords(path)).orderBy("chunk").collect()
    assert [(c.first_pos, c.last_pos, c.n_tokens, c.text) for c in got] == loop([(i, t, count(t)) for i, t in enumerate(lines)], 80, 100, 25)
    long = spark.createDataFrame([(1, 0, "nosentence" * 60)], "d int, p int, t string")
    parts = C.units(long, "d", "p", "t", most=20, tokens=C.Subwords(path)).orderBy("i").collect()
    assert "".join(p.text for p in parts) == "nosentence" * 60 and all(count(p.text) <= 22 for p in parts) and len(parts) > 3


def test_lines_go_to_the_vocabulary_a_few_at_a_time():
    texts = ["a" * n for n in (0, 5, 20, 0, 1, 9, 9, 9, 9, 0)]
    got = list(C._slices(texts, 20))
    assert [t for some in got for t in some] == texts and len(got) == 3 and all(sum(map(len, some[:-1])) < 20 for some in got)
    assert list(C._slices([])) == []


def test_texts_are_counted_once(spark):
    """The rows' texts are read and counted by one scan, whatever the number of branches that use the counts."""
    docs = spark.createDataFrame([(1, 0, "a b c. D e f g h"), (2, 0, "x")], "k int, p int, text string")
    count = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        count.add(1)
        return t

    C.units(docs.withColumn("text", seen("text")), "k", "p", "text", most=3).collect()
    assert count.value == 2
