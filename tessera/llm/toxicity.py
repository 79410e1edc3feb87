"""Toxicity (1): a weighted lexicon, matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lowers case, strips accents and zero-width characters, maps look-alike letters of other scripts to Latin ones and
digits to the letters they stand for, and turns punctuation into spaces. The lexicon holds whole words and word
beginnings; entries and weights are learned from a bounded labelled sample, added to what the caller gives.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.calibrate import Logistic, labelled_sample
from tessera.llm.common import filter_rows, map_batches, remainder, stored

# Letters of other scripts and the Latin letters that they look like, capitals first (some look like another letter than their small form).
_CAPITALS = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹՏՕՍԼ", "ABESIJKMHOPCTYXYGQWABEZHIKMNOPTYXCSOUL"))
_LOOKALIKES = dict(zip("авеѕіјкмнорстухҽһԁԛԝгпьӏү" + "αβεηικμνορτυχωγσϲɑɡɩ" + "աոսօզցհյքւ", "abesijkmhopctyxehdqwrnbly" + "abenikuvoptuxwyocagi" + "wnuoqghjpl"))
#: What digits stand for; l, 1 and i fold into one.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
# Phrases in which a listed word is harmless.
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bin", "pond scum", "stupid simple", "sore loser rule")

_MARKS = re.compile("[̀-ͯ­​-‏⁠﻿]+")
_TABLE = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord(k): v for k, v in _DIGITS.items()}
_OTHER_SCRIPT = re.compile("[\u0370-\u058f]")
_CAPITAL_TABLE = str.maketrans(_CAPITALS)
_WIDE_TABLE = _TABLE | {ord(k): _DIGITS.get(v, v) for k, v in _LOOKALIKES.items()} | {i: " " for i in (*range(0x2000, 0x2070), *range(0x3000, 0x3004), 0xA0, 0xA1, 0xAB, 0xB7, 0xBB, 0xBF)}
# signs count as letters only next to letters: mail addresses and prices stay apart from words of junk
_SIGNS = re.compile(r"(?<=[a-z])[@!|](?=[a-z])|(?<![^\s])[@!](?=[a-z])|\$(?=[a-z])")
#: What signs stand for.
_SIGN_LETTERS = {"@": "a", "$": "s", "!": "i", "|": "i"}


def fold(text: str | None) -> str:
    """The form in which the lexicon is matched, between spaces."""
    t = text or ""
    if t.isascii():
        t = t.lower()
    else:
        if _OTHER_SCRIPT.search(t):  # the lunate sigma has a normal form that looks otherwise
            t = unicodedata.normalize("NFKD", t.replace("Ϲ", "C").replace("ϲ", "c")).translate(_CAPITAL_TABLE)
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t)).lower()
    if any(x in t for x in _SIGN_LETTERS):
        t = _SIGNS.sub(lambda m: _SIGN_LETTERS[m[0]], t)
    return f" {t.translate(_TABLE if t.isascii() else _WIDE_TABLE)} "


@dataclass
class Lexicon:
    """``whole`` words and word ``starts`` with weights, and phrases in which they do not count; all in any spelling, for they are folded."""

    whole: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def matcher(self):
        """A function from text to (total weight, hits, distinct entries, words)."""
        import ahocorasick

        a = ahocorasick.Automaton()
        # entries are folded as texts are; of several with one folded form the heaviest counts
        form = lambda w: " ".join(fold(w).split())
        for w, x in sorted(self.whole.items(), key=lambda e: e[1]):
            if form(w):
                a.add_word(f" {form(w)} ", (form(w), x, len(form(w)) + 2))
        for w, x in sorted(self.starts.items(), key=lambda e: e[1]):
            if form(w):
                a.add_word(f" {form(w)}", (form(w) + "*", x, len(form(w)) + 1))
        for p in filter(form, self.exceptions):
            a.add_word(f" {form(p)} ", (None, 0.0, len(form(p)) + 2))
        if not len(a):
            return lambda text: (0.0, 0, 0, len(fold(text).split()))
        a.make_automaton()

        def measure(text: str | None) -> tuple[float, int, int, int]:
            folded = fold(text)
            hits = list(a.iter(folded))
            if not hits:
                return 0.0, 0, 0, 0
            held = folded.split()
            words = len(held)
            hits = list(a.iter(f" {' '.join(held)} "))  # phrases go over signs and line ends
            free = [(e - n, e) for e, (w, _, n) in hits if w is None]
            counted = [(w, x) for e, (w, x, n) in hits if w is not None and not any(s <= e - n and e <= t + 1 for s, t in free)]
            return sum(x for _, x in counted), len(counted), len({w for w, _ in counted}), words

        return measure


def _features(text: str) -> set[str]:
    """Whole words of 2 letters or more (with a final space) and word beginnings of 4 to 8 letters."""
    out = set()
    for w in set(fold(text).split()):
        if 2 <= len(w) <= 24:
            out.add(w + " ")
            out.update(w[:k] for k in range(4, min(9, len(w))))
    return out


def _sketch(text: str) -> int:
    """Equal for most near copies: the least hash of the text's windows of five words, as a signed number."""
    w = fold(text).split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) - (1 << 63)


def learn_lexicon(sample: DataFrame, *, least_docs: int = 5, least_gain: float = 24.0, entries: int = 4000) -> Lexicon:
    """Entries whose presence marks toxic documents of the sample, by log-likelihood ratio; weights are log odds.

    Near copies count once (one of each sketch). A longer entry gives way to its better beginning, and the other way.
    """
    sketch = map_batches(sample, ["text", "y"], "text string, y int, sketch long", lambda: lambda t, y: {"text": t, "y": y, "sketch": [_sketch(x) for x in t]})
    # the same one for any partitioning, and one sample for all the counts below
    rows = stored(sketch.groupBy("sketch").agg(F.min(F.struct("y", "text")).alias("x")).select("x.text", "x.y"), "sketches")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon()

    def counts(part: DataFrame, among: set[str] | None) -> DataFrame:
        def make():
            def step(texts):
                n = Counter()
                for t in texts:
                    n.update(_features(t) if among is None else among.intersection(_features(t)))
                return {"f": list(n), "n": list(n.values())}

            return step

        return map_batches(part, ["text"], "f string, n long", make).groupBy("f").agg(F.sum("n").alias("n"))

    # features of a bounded sample; the count below is bounded by `entries` * 10
    found = counts(rows.where("y = 1"), None).where(F.col("n") >= least_docs).orderBy(F.desc("n"), "f").limit(entries * 10)
    in_toxic = {r.f: r.n for r in found.collect()}
    in_clean = {r.f: r.n for r in counts(rows.where("y = 0"), set(in_toxic)).collect()}

    def gain(t: int, c: int) -> float:
        rate = (t + c) / (toxic + clean)
        return 2 * sum(k * math.log(k / (n * p)) for k, n, p in ((t, toxic, rate), (c, clean, rate), (toxic - t, toxic, 1 - rate), (clean - c, clean, 1 - rate)) if k and p > 0)

    scored = []
    for f, t in in_toxic.items():
        c = in_clean.get(f, 0)
        weight = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        if weight >= 3 and (g := gain(t, c)) >= least_gain:
            scored.append((-g, -len(f), f, weight))
    lexicon = Lexicon()
    covered: set[str] = set()
    for _, _, f, weight in sorted(scored)[: entries * 2]:
        word = f.rstrip(" ")
        if any(word[:k] in lexicon.starts for k in range(4, len(word) + 1)) or (f == word and f in covered):
            continue
        if f == word:
            lexicon.starts[word] = weight
        else:
            lexicon.whole[word] = weight
        covered.update(word[:k] for k in range(4, len(word) + 1))
    return lexicon


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    calibration: Logistic

    def scorer(self):
        measure = self.lexicon.matcher()

        def score(texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
            got = [measure(t) for t in texts]
            return self.calibration(_shape(got)), [g[1] for g in got]

        return score


def _shape(got: list[tuple[float, int, int, int]]) -> np.ndarray:
    """Total weight, and weight against length."""
    if not got:
        return np.zeros((0, 2))
    g = np.array(got, float)
    return np.column_stack([np.log1p(g[:, 0]), np.log1p(100 * g[:, 0] / (g[:, 3] + 50))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = 4000, lexicon: Lexicon | None = None) -> ToxicityModel:
    """Learn lexicon and calibration from at most ``2 * per_class`` labelled documents."""
    sample = labelled_sample(docs, labels, "toxic", per_class=per_class)

    def learned(part: DataFrame) -> Lexicon:
        found = learn_lexicon(part)
        return Lexicon(found.whole | lexicon.whole, found.starts | lexicon.starts, tuple(dict.fromkeys(found.exceptions + lexicon.exceptions))) if lexicon else found

    # each half is measured with what the other half taught, so the calibration sees honest weights
    rows = []
    for half in (0, 1):
        other = learned(sample.where(f"half = {1 - half}"))

        def make(other=other):
            measure = other.matcher()

            def step(texts, ys):
                got = [measure(t) for t in texts]
                return {"s": [g[0] for g in got], "h": [g[1] for g in got], "d": [g[2] for g in got], "w": [g[3] for g in got], "y": ys}

            return step

        rows += map_batches(sample.where(f"half = {half}"), ["text", "y"], "s double, h int, d int, w int, y int", make).collect()  # numbers of the bounded sample
    return ToxicityModel(learned(sample), Logistic(_shape([r[:4] for r in rows]), np.array([r.y for r in rows])))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted and hits for every row.

    Null and empty texts have no hits and get the score of a text without hits. A null doc_id is in no fold (not held out).
    Without labels of both classes every score is the smoothed base rate. Repeated rows are scored each; other
    columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, **options))

    def make():
        score = shared.value.scorer()

        def step(keys, texts):
            s, hits = score(texts)
            return {"doc_id": keys, "score": s, "hits": hits}

        return step

    scored = map_batches(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, hits int", make)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs``, all their columns, whose score is under ``threshold``.

    Null and empty texts have the score of a text without hits. Rows without doc_id and repeated rows are judged each; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, **options))

    def make():
        score = shared.value.scorer()
        return lambda texts: score(texts)[0] < threshold

    return filter_rows(docs, ["text"], make)
