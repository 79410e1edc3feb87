"""Token counts and binary files against the library itself, and the coder alone."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simple8b
from tessera.llm.common import scratch
from tessera.llm.pieces import PieceTable
from tessera.llm.token_binary import read_tokens, write_tokens
from tessera.llm.token_counts import default_tokenizer, token_counts

ODD = [None, "", " ", "a  b", "\n\n x", " lead", "trail ", "a b <|endoftext|> c", "x\ty z\r\nq", "it's don't 12,3 ñé.$$$ *** a", "\x1c a \x1d", " b ​ z", "日本語 テスト… ok", "word " * 30_000, "same text", "same text"]
SCHEMA = "doc_id long, text string, n_tokens string, start string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 7 % 16, t, "x", None, None) for i, t in enumerate(ODD)], SCHEMA)


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return {i * 7 % 16: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(ODD)}


def test_counts(docs, ids):
    got = {r.doc_id: r for r in token_counts(docs).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == {k: len(v) for k, v in ids.items()}
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.values())
    assert {r.n_bytes for k, r in got.items() if not ids[k]} == {0}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t.,'abcÀé1_  !"), max_size=40))
def test_pieces_are_exact(text):
    global TABLE
    TABLE = globals().get("TABLE") or PieceTable(default_tokenizer(), len, lambda a, b: a + b)
    first, rest = TABLE.of(text)
    assert first + sum(rest) == TABLE.encode(text)


def test_empty_table(spark, docs):
    none = docs.where("false")
    assert token_counts(none).count() == 0
    write_tokens(none, path := scratch(spark, "none"))
    assert read_tokens(spark, path).count() == 0


def test_files(spark, docs, ids):
    write_tokens(docs, path := scratch(spark, "tokens"), parts=3)
    rows = read_tokens(spark, path, with_ids=True).orderBy("doc_id").collect()
    at = 0
    for r in rows:
        want = [*ids[r.doc_id], 0]
        assert r.ids == want and r.start == at and r.n_tokens == len(want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    assert len(rows) == len(ODD)


def test_files_of_null_and_repeated_ids(spark):
    """Rows without id come first, equal ids side by side, a very long text between short ones; starts follow from all before."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    texts = [(None, "no id"), (-(1 << 63), "least"), (7, "b"), (7, "a longer one"), (None, None), (3, "word " * 400_000), (-5, ""), (7, "b"), (1 << 40, "x y z")]
    made = spark.createDataFrame([(k, t, "q", 1) for k, t in texts], "doc_id long, text string, words string, part int").repartition(3)
    write_tokens(made, path := scratch(spark, "odd"), parts=4)
    rows = read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in rows) == sorted((k is not None, k or 0, ids(t)) for k, t in texts)
    assert [r.doc_id for r in rows] == [None, None, -(1 << 63), -5, 3, 7, 7, 7, 1 << 40]
    assert [r.start for r in rows] == [sum(len(x.ids) for x in rows[:i]) for i in range(len(rows))]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), max_size=6))
def test_simple8b_runs(runs):
    v = np.array([x for r in runs for x in r], np.uint64)
    lengths = [len(r) for r in runs]
    words, offsets, escapes = simple8b.encode(v, lengths)
    assert (simple8b.decode(words, offsets, escapes, lengths) == v).all()
    assert len(offsets) == sum(-(-n // simple8b.BLOCK) for n in lengths)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, offsets, escapes = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, escapes, len(v)) == v).all()
    assert len(offsets) == -(-len(v) // simple8b.BLOCK)
