"""Quality rules (6): cutoffs that labelled holdouts allow, with exact binomial bounds and a correction for multiple testing.

Every rule is a permille figure of the text, larger is worse. Labelled documents that pass the base rules, one of each group of near
copies, are split by a hash: a third is for tuning, two thirds are the holdout. Strata are bands of the number of words; a band with too few
good documents in the holdout to pass even without a loss is joined with the next longer one, the last with the one before it.

In each stratum the tuning part gives one path of rule sets, from no cutoff to ever stricter ones: at a step every rule takes, of the cutoffs that lose at
most the step's share of good documents, the one that rejects most bad documents less a price for good ones; a rule that gains nothing stays
out. The rule sets are nested, and the holdout tests them in that order until one fails: a rule set is allowed if the exact
(Clopper-Pearson) upper bound on the share of good documents that all its cutoffs together reject, at the error level divided
by the number of bands (Bonferroni; the fixed order needs no more), is within the allowed false rejection. Of the allowed ones that with most
gain in the tuning part is taken. So with probability ``1 - error`` no stratum loses more than ``false_rejection`` of its good documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filter_rows, map_batches, stored

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "dup_lines", "repeats", "capitals", "shouts", "long_words", "short_words")
#: Upper ends (words) of the bands; the last is open.
BANDS = (50, 200, 1000)
GRID = tuple(range(0, 1001, 20))
#: Steps of the path: the share of good tuning documents that a rule may lose by itself.
STEPS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02)

_UPPER = bytes(range(65, 91))
_NOT_LETTERS = bytes(set(range(256)) - set(range(65, 91)) - set(range(97, 123)))
_BLANKS = bytes((32, *range(9, 14)))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five words that the text holds twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total, covered = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 5 - max(i, covered)
            covered = i + 5
    return total


def measures(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the permille figures of ``RULES``."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0) + (0,) * len(RULES)
    chars = len(text) - (len(raw) - len(raw.translate(None, _BLANKS)))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    letters = raw.translate(None, _NOT_LETTERS)
    upper = len(letters) - len(letters.translate(None, _UPPER))
    mean = chars / n
    figures = (
        1000 * symbols // max(1, chars),
        1000 * dup // max(1, len(lines)),
        1000 * repeat // n,
        1000 * upper // max(1, len(letters)),
        1000 * raw.count(b"!") // n,
        int(1000 * max(0.0, mean - 5) / 20),
        int(1000 * max(0.0, 5 - mean) / 5),
    )
    return (n, chars, symbols, dup, repeat, *(min(1000, f) for f in figures))


def sketch(words: list[bytes]) -> int:
    """Equal for most near copies: the least hash of the text's windows of five words."""
    if len(words) < 5:
        return -1
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    total = np.zeros(len(h) - 4, np.uint64)
    for k in range(5):
        total = (total + h[k : k + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return int((total * np.uint64(0xBF58476D1CE4E5B9)).min() >> np.uint64(1))


def band(n_words: int) -> int:
    return sum(n_words >= b for b in BANDS)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the share p at which ``k`` or fewer of ``n`` have probability ``error``."""
    if k >= n:
        return 1.0
    ks = range(k + 1)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in ks]

    def tail(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        terms = [c + i * a + (n - i) * b for i, c in zip(ks, logs)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid < 1 and tail(min(mid, 1 - 1e-15)) > error else (low, mid)
    return high


@dataclass(frozen=True)
class RuleSet:
    """(band, rule index) -> cutoff; a document whose figure is over a cutoff of its band is rejected. ``strata``: bands that were joined."""

    cutoffs: dict[tuple[int, int], int]
    strata: tuple[tuple[int, ...], ...] = field(default=())

    def keeps(self, m: tuple[int, ...]) -> bool:
        if base_failed(m[0], m[4]):
            return False
        b = band(m[0])
        return not any(m[5 + r] > c for (s, r), c in self.cutoffs.items() if s == b)


def strata_of(good: dict[int, int], need: int) -> tuple[tuple[int, ...], ...]:
    """Bands in groups of at least ``need`` good holdout documents, but for one group that is all there is."""
    out: list[list[int]] = [[]]
    for b in range(len(BANDS) + 1):
        out[-1].append(b)
        if sum(good.get(x, 0) for x in out[-1]) >= need:
            out.append([])
    last = out.pop()
    if last and out:
        out[-1] += last
    return tuple(map(tuple, out if out else [last]))


def path_of(counts: dict[tuple[int, int, int], int], price: float) -> list[dict[int, int]]:
    """Nested rule sets (rule -> cutoff), one for each step, from tuning ``counts``: (rule, good 0/1, figure on the grid) -> documents."""
    path: list[dict[int, int]] = [{} for _ in STEPS]
    for r in range(len(RULES)):
        good, bad = (np.array([counts.get((r, y, g), 0) for g in GRID]) for y in (1, 0))
        # documents over each cutoff of the grid but the last, which rejects nothing
        lost, hit = good.sum() - np.cumsum(good)[:-1], bad.sum() - np.cumsum(bad)[:-1]
        gain = hit - price * lost
        for k, share in enumerate(STEPS):
            fits = np.flatnonzero(lost <= share * good.sum())
            if len(fits):
                best = fits[gain[fits] == gain[fits].max()][-1]
                if gain[best] > 0:
                    path[k][r] = GRID[best]
    return path


def allowed_steps(lost: list[int], good: int, *, false_rejection: float, error: float) -> int:
    """How many steps of a nested path pass, tested in order up to the first failure: ``lost`` of ``good`` holdout documents at each."""
    n = 0
    for k in lost:
        if not good or k > good * false_rejection or upper_bound(k, good, error) > false_rejection:
            break
        n += 1
    return n


def _banded() -> Column:
    return sum(((F.col("n_words") >= b).cast("int") for b in BANDS), F.lit(0))


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _on_grid(rule: str) -> Column:
    return (F.ceil(F.col(f"r_{rule}") / GRID[1]) * GRID[1]).cast("int")


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"r_{x}" for x in RULES))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the figures and the sketch of every row."""

    def make():
        def step(keys, texts):
            got = list(zip(*map(measures, texts))) or [()] * len(_COLUMNS)
            return {"doc_id": keys, "sketch": [sketch((t or "").encode().split()) for t in texts]} | dict(zip(_COLUMNS, got))

        return step

    return map_batches(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sketch long, " + ", ".join(f"{c} long" for c in _COLUMNS), make)


def _labels(labels: DataFrame) -> DataFrame:
    """One label an id: of repeated rows the worse."""
    return labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"))


def fit_rules(figures: DataFrame, labels: DataFrame, *, false_rejection: float = 0.02, error: float = 0.05, price: float = 3.0) -> RuleSet:
    """The rule set that the labelled rows of ``figures`` allow. Two tables of counts of bounded size come to the driver."""
    usable = figures.where(~_failed()).join(_labels(labels), "doc_id")
    held = ["y", _banded().alias("band"), *(_on_grid(r).alias(r) for r in RULES)]
    rows = usable.select("sketch", "doc_id", *held).groupBy("sketch").agg(F.min(F.struct("doc_id", "y", "band", *RULES)).alias("x"))
    rows = stored(rows.select((F.pmod(F.xxhash64(F.lit("fold"), "sketch"), F.lit(3)) == 0).alias("tuning"), "x.y", "x.band", *(f"x.{r}" for r in RULES)), "labelled")
    figure = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(r).alias("g")) for i, r in enumerate(RULES)])).alias("f")
    counts = rows.select("tuning", "y", "band", figure).groupBy("tuning", "y", "band", "f.rule", "f.g").agg(F.count("*").alias("n")).collect()
    good = Counter()
    for c in counts:
        if not c.tuning and c.y == 1 and c.rule == 0:
            good[c.band] += c.n
    error /= len(BANDS) + 1
    strata = strata_of(good, math.ceil(math.log(error) / math.log1p(-false_rejection)))
    paths = {}
    for s in strata:
        tuning = Counter()
        for c in counts:
            if c.tuning and c.band in s:
                tuning[c.rule, c.y, c.g] += c.n
        paths[s] = path_of(tuning, price)
    # the first step of its stratum's path that rejects a document: the sets are nested, so it is the number of steps that keep it
    first = F.lit(len(STEPS))
    for s, path in paths.items():
        kept = [sum((F.lit(True) if r not in step else F.col(name) <= step[r]).cast("int") for step in path) for r, name in enumerate(RULES)]
        first = F.when(F.col("band").isin(*s), F.least(*kept)).otherwise(first)
    at = Counter()
    for c in rows.groupBy("tuning", "y", "band", first.alias("first")).agg(F.count("*").alias("n")).collect():
        at[c.tuning, c.y, next(s for s in strata if c.band in s), c.first] += c.n
    cutoffs = {}
    for s, path in paths.items():
        over = lambda tuning, y, k: sum(at[tuning, y, s, i] for i in range(k + 1))  # noqa: B023, E731
        n = allowed_steps([over(False, 1, k) for k in range(len(STEPS))], sum(good[b] for b in s), false_rejection=false_rejection, error=error)
        gains = [over(True, 0, k) - price * over(True, 1, k) for k in range(n)]
        if gains and max(gains) > 0:
            cutoffs |= {(b, r): c for b in s for r, c in path[gains.index(max(gains))].items()}
    return RuleSet(cutoffs, strata)


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base figures, base_failed and kept for every row.

    Null and empty texts have no words and fail the base. With too few labelled good documents in all no cutoff passes its
    test, and only the base rules apply. A null doc_id has no label. Repeated rows are judged each; an empty table gives
    an empty table; other columns are ignored.
    """
    figures = stored(measured(docs), "figures")
    rules = fit_rules(figures, labels, **options)
    over = F.lit(False)
    for (s, r), c in rules.cutoffs.items():
        over = over | ((_banded() == s) & (F.col(f"r_{RULES[r]}") > c))
    return figures.select("doc_id", *_COLUMNS[:5], _failed().alias("base_failed"), (~_failed() & ~over).alias("kept"))


def drop_by_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all their columns, that the base rules and the chosen cutoffs keep.

    Null and empty texts fail the base and go. A row without doc_id is judged by its text like others, and has no label. Repeated rows are judged
    each; an empty table stays empty. No text is shuffled: figures are measured where the texts are, and only they meet the labels.
    """
    rules = fit_rules(measured(docs), labels, **options)

    def make():
        return lambda texts: [rules.keeps(measures(t)) for t in texts]

    return filter_rows(docs, ["text"], make)
