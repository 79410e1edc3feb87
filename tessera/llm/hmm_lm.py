"""LM scoring (4): a hidden Markov language model beside the add-one unigram base.

Tokens are lower-cased words and one end a document. The ``own`` most frequent words, and the end, are symbols of their own; every other
word belongs to the symbol of its last bytes, inside which it has its add-one share, and an unseen word has the share of a count
of 0. The states emit symbols. One state alone gives the base; more states learn languages, registers and word order.

Baum-Welch starts from the neighbours of every symbol, counted over all training documents: symbols with like neighbours begin in one
state. Whole passes over all training documents follow, whose expected counts are summed across partitions; nothing is learnt from a sample. The scaled forward recursion gives a document's exact log-likelihood.
Counts of frequent words are broadcast (a fixed number); those of all others are joined on the word, so no table of the corpus's
words meets in one place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_batches, remainder, stored
from tessera.llm.words import word_hashes

#: Tokens of a training segment; documents are cut into these for Baum-Welch, never for scoring.
SEGMENT = 64
_CACHE = 400_000
#: Characters of the texts whose symbols are found at once.
_CHARS = 1 << 20
#: Classes of neighbours on each side of a symbol.
_SIDE = 64


def words_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z in lower case; bytes.split cuts at exactly 0x20 and 0x09-0x0D."""
    return (text or "").encode().lower().split()


class Symbols:
    """Words to symbols: frequent words have their own (found by their 64-bit hashes), others that of their last bytes."""

    def __init__(self, own: list[bytes], suffixes: int):
        self.own, self.suffixes = len(own), suffixes
        hashes = word_hashes(b" ".join(own))[0]
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64(0))

    @property
    def end(self) -> int:
        return self.own + self.suffixes

    @property
    def size(self) -> int:
        return self.own + self.suffixes + 1

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' symbols, each text's followed by the end, and how many each has."""
        held = [(t or "").encode().lower() for t in texts]
        raw = b" ".join(held)
        h, starts, ends = word_hashes(raw)
        at = np.searchsorted(self.hashes[:-1], h)
        known = (self.hashes[at] == h) & (at < self.own)
        buffer = np.concatenate([np.zeros(2, np.uint8), np.frombuffer(raw, np.uint8)])
        last = buffer[ends + 1].astype(np.int64)
        for k in (1, 2):
            last += np.where(ends - starts > k, buffer[ends + 1 - k].astype(np.int64) << 8 * k, 0)
        symbol = np.where(known, np.append(self.order, 0)[at], self.own + _mixed(last, self.suffixes))
        first = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in held)]))
        lengths = np.diff(first) + 1
        out = np.full(int(lengths.sum()), self.end, np.int32)
        out[np.arange(len(symbol)) + np.repeat(np.arange(len(texts)), lengths - 1)] = symbol
        return out, lengths


class Codes(dict):
    """word -> its place among the broadcast words, or their number plus the symbol of its last bytes."""

    def __init__(self, frequent: list[bytes], suffixes: int):
        super().__init__({w: i for i, w in enumerate(frequent)})
        self.frequent, self.suffixes = len(frequent), suffixes
        self.first = dict(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
            self.update(self.first)
        got = self[word] = self.frequent + suffix_symbol(word, self.suffixes)
        return got


def _mixed(last, suffixes: int):
    return ((last * 0x9E3779B1 & 0xFFFFFFFF) >> 13) % suffixes


def suffix_symbol(word: bytes, suffixes: int) -> int:
    """One of ``suffixes`` symbols, by the last three bytes."""
    return _mixed(sum(b << 8 * k for k, b in enumerate(reversed(word[-3:]))), suffixes)


@dataclass
class HMM:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each sequence of symbols, by the forward recursion with a scale at every step."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        if not len(lengths):
            return np.zeros(0)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate(sequences)
        begin = (np.cumsum(lengths) - lengths)[order]
        live = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")  # sequences longer than t
        a, out = np.tile(self.start, (len(order), 1)), np.zeros(len(order))
        for t, n in enumerate(live.tolist()):
            a = (a[:n] if t == 0 else a[:n] @ self.move) * self.emit[flat[begin[:n] + t]]
            scale = a.sum(1)
            a /= scale[:, None]
            out[:n] += np.log10(scale)
        result = np.empty(len(order))
        result[order] = out
        return result

    def expected(self, grid: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts of start, move and emit over segments (rows; -1 pads the ends); ``first`` marks documents' beginnings."""
        n, steps = grid.shape
        k, pad = len(self.start), len(self.emit)
        emit = np.vstack([self.emit, np.ones(k)])
        obs = np.where(grid < 0, pad, grid)
        alpha, seen = np.empty((steps, n, k)), emit[obs.T]
        a = np.where(first[:, None], self.start, self._rest()) * seen[0]
        for t in range(steps):
            if t:
                a = (alpha[t - 1] @ self.move) * seen[t]
            alpha[t] = a / a.sum(1, keepdims=True)
        beta, moves, back = np.ones((n, k)), np.zeros((k, k)), self.move.T
        gamma = np.empty_like(alpha)
        gamma[-1] = alpha[-1]
        for t in range(steps - 2, -1, -1):
            ahead = beta * seen[t + 1]
            b = ahead @ back
            g = alpha[t] * b
            total = g.sum(1, keepdims=True)
            gamma[t] = g / total
            real = (obs[:, t + 1] != pad)[:, None]
            moves += (alpha[t] * real / total).T @ ahead
            beta = b / b.sum(1, keepdims=True)
        flat, weights = obs.T.ravel(), gamma.reshape(-1, k)
        emits = np.stack([np.bincount(flat, weights[:, i], pad + 1)[:pad] for i in range(k)], 1)
        return gamma[0][first].sum(0), moves * self.move, emits

    def _rest(self) -> np.ndarray:
        """Distribution of states inside a document."""
        p = np.full(len(self.start), 1 / len(self.start))
        for _ in range(64):
            p = p @ self.move
        return p / p.sum()

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray, weight: float) -> HMM:
        """Counts to probabilities; emissions lean on ``prior`` (the base's symbol probabilities) with ``weight`` counts."""
        k = len(start)
        e = emit + weight * prior[:, None]
        return HMM((start + 1) / (start.sum() + k), (move + 1) / (move.sum(1, keepdims=True) + k), e / e.sum(0))


def segments_of(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``SEGMENT`` symbols of sequences that stand one behind the other, padded with -1, and which rows begin a sequence."""
    n = -(-lengths // SEGMENT)
    begin = np.cumsum(n) - n
    grid = np.full(int(n.sum()) * SEGMENT, -1, np.int32)
    grid[np.arange(len(flat)) + np.repeat(begin * SEGMENT - (np.cumsum(lengths) - lengths), lengths)] = flat
    first = np.zeros(int(n.sum()), bool)
    first[begin] = True
    return grid.reshape(-1, SEGMENT), first


def _flats(texts: list[str | None], symbols: Symbols) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of the texts and how many each has, some texts at a time."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= _CHARS or i + 1 == len(texts):
            yield symbols.of(texts[at : i + 1])
            at, size = i + 1, 0


def _grids(texts: list[str | None], symbols: Symbols) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Segments of the texts, some at a time."""
    for flat, lengths in _flats(texts, symbols):
        yield segments_of(flat, lengths)


@dataclass
class Model:
    own: list[bytes]
    suffixes: int
    frequent: dict[bytes, int]
    suffix_mass: np.ndarray  # sum of (count + 1) of each suffix symbol's words, plus 1 for the unseen
    tokens: int
    types: int
    documents: int
    hmm: HMM | None = None

    def symbols(self) -> Symbols:
        return Symbols(self.own, self.suffixes)

    def prior(self) -> np.ndarray:
        """The base's probability of each symbol."""
        mass = np.concatenate([[self.frequent[w] + 1.0 for w in self.own], self.suffix_mass, [self.documents + 1.0]])
        return mass / mass.sum()


def token_table(docs: DataFrame) -> DataFrame:
    """word, n: counts over all rows, summed on the map side by batch."""

    def make():
        def step(texts):
            c = Counter()
            for t in texts:
                c.update(words_of(t))
            return {"word": list(c), "n": list(c.values())}

        return step

    return map_batches(docs, ["text"], "word binary, n long", make).groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """At most ``most`` words with their counts, the commonest first: all that reach a count under which there would be more.

    The cutoff comes from a histogram of a thousand bins, so that no partition sends more than its share of the result.
    """
    place = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    bins = counts.groupBy(place.alias("b")).agg(F.count("*").alias("k")).orderBy(F.desc("b")).collect()
    total, cut = 0, None
    for r in bins:
        total += r.k
        if total > most:
            break
        cut = r.b
    held = [] if cut is None else counts.where(place >= cut).collect()
    return {bytes(r.word): r.n for r in sorted(held, key=lambda r: (-r.n, bytes(r.word)))}


def fit(docs: DataFrame, counts: DataFrame, *, states: int = 8, own: int = 4096, frequent: int = 65_536, suffixes: int = 256, passes: int = 2, sample_segments: int | None = None, weight: float = 50.0, seed: int = 7) -> Model:
    """Train on all rows of ``docs``; ``counts`` is their stored token table. ``sample_segments`` is for older callers and has no effect: no
    segments are sampled."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    documents = docs.count()
    top = frequent_words(counts, frequent)
    words = list(top)[:own]

    def make():
        mine = set(words)

        def step(ws, ns):
            mass = np.zeros(suffixes)
            for w, n in zip(ws, ns):
                if bytes(w) not in mine:
                    mass[suffix_symbol(bytes(w), suffixes)] += n + 1
            at = np.flatnonzero(mass)
            return {"g": at.tolist(), "m": mass[at].tolist()}

        return step

    mass = np.ones(suffixes)
    for r in map_batches(counts, ["word", "n"], "g int, m double", make).groupBy("g").agg(F.sum("m").alias("m")).collect():
        mass[r.g] += r.m
    model = Model(words, suffixes, top, mass, total.n + documents, total.v + (documents > 0), documents)
    model.hmm = _start(docs, model, states, weight, seed)
    for _ in range(passes):
        model.hmm = _pass(docs, model, weight)
    return model


def neighbours(docs: DataFrame, model: Model) -> np.ndarray:
    """symbols x (2 x ``_SIDE``): how often each symbol stands behind and before symbols of each class, over all of ``docs``.

    A frequent word is a class of its own, as are the ends; other symbols share the rest. A document's first symbol stands behind an end.
    Whole numbers are summed, so partitions do not matter; the driver gets a bounded table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size, width = len(model.prior()), 2 * _SIDE

    def make():
        symbols = shared.value.symbols()
        classes = _classes(symbols)

        def step(texts):
            total = np.zeros(size * width, np.int64)
            for flat, _ in _flats(texts, symbols):
                here, met = flat.astype(np.int64) * width, classes[flat]
                behind = np.concatenate([[classes[symbols.end]], met[:-1]])
                inner = np.flatnonzero(flat != symbols.end)
                total += np.bincount(here + behind, minlength=len(total)) + np.bincount(here[inner] + _SIDE + met[inner + 1], minlength=len(total))
            at = np.flatnonzero(total)
            return {"cell": at.tolist(), "n": total[at].tolist()}

        return step

    got = map_batches(docs, ["text"], "cell int, n long", make).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * width)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, width)


def _classes(symbols: Symbols) -> np.ndarray:
    """The class, under ``_SIDE``, of every symbol: half of them are the most frequent words' own, the last is the end's."""
    own, at = _SIDE // 2, np.arange(symbols.size)
    out = np.where(at < min(own, symbols.own), at, own + at % (_SIDE - own - 1))
    out[symbols.end] = _SIDE - 1
    return out


def _start(docs: DataFrame, model: Model, states: int, weight: float, seed: int) -> HMM:
    """Parameters to start from: ``states`` clusters of symbols by their neighbours over the whole corpus, then rounds of Baum-Welch on these counts."""
    rng, prior, met = np.random.default_rng(seed), model.prior(), neighbours(docs, model)
    before, after = met[:, :_SIDE], met[:, _SIDE:]
    counts = before.sum(1)
    shares = np.sqrt(np.hstack([side / np.maximum(side.sum(1, keepdims=True), 1) for side in (before, after)]))
    belongs = np.full((len(prior), states), 0.2 / states)
    belongs[np.arange(len(prior)), _clusters(shares, np.sqrt(counts), states, rng)] += 0.8
    belongs *= rng.uniform(0.9, 1.1, belongs.shape)  # clusters without symbols must not stay alike
    emit, move, classes = belongs * (counts + prior)[:, None], np.ones((states, states)) + np.eye(states), _classes(model.symbols())
    for _ in range(200):
        emit, move = _pair_round(emit, move, before, after, classes)
    shown = (emit + 1e-9 * prior[:, None]) / (emit + 1e-9 * prior[:, None]).sum(1, keepdims=True)
    return HMM.from_counts(shown.T @ before[:, -1], move, emit, prior, weight)


def _pair_round(emit: np.ndarray, move: np.ndarray, before: np.ndarray, after: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Baum-Welch counts of emit and move from pairs: a symbol and the class of the symbol behind which, or before which, it stands."""
    tiny = 1e-12
    share = (emit.sum(0) + tiny) / (emit.sum() + tiny)
    e = emit / (emit.sum(0) + tiny)
    of_class = np.stack([np.bincount(classes, e[:, i], _SIDE) for i in range(len(move))], 1)
    onward = (move + tiny) / (move + tiny).sum(1, keepdims=True)
    back = (share[:, None] * onward).T
    back /= back.sum(1, keepdims=True)
    mass, emits, moves = e * share, 0.0, 0.0
    for table, step, turned in ((after, onward, False), (before, back, True)):
        ahead = of_class @ step.T
        ratio = table / (mass @ ahead.T + tiny)
        emits = emits + mass * (ratio @ ahead)
        pairs = step * (mass.T @ ratio @ of_class)
        moves = moves + (pairs.T if turned else pairs)
    return emits / 2, moves / 2


def _clusters(rows: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The cluster of every row, by weighted k-means from spread centres."""
    far = np.ones(len(rows))
    centres = []
    for _ in range(k):
        mass = np.cumsum(weights * far)
        centres.append(rows[min(int(np.searchsorted(mass, rng.random() * mass[-1], side="right")), len(rows) - 1)])
        gap = ((rows - centres[-1]) ** 2).sum(1)
        far = gap if len(centres) == 1 else np.minimum(far, gap)
    centre = np.array(centres)
    for _ in range(30):
        place = ((centre**2).sum(1) - 2 * rows @ centre.T).argmin(1)
        size = np.bincount(place, weights, k)
        sums = np.stack([np.bincount(place, weights * rows[:, j], k) for j in range(rows.shape[1])], 1)
        centre = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-9)[:, None], centre)
    return place


def _pass(docs: DataFrame, model: Model, weight: float) -> HMM:
    """One round of Baum-Welch over all of ``docs``: a row for each symbol and task is shuffled, symbols x states come to the driver."""
    k, size = len(model.hmm.start), len(model.hmm.emit)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("symbol", T.IntegerType()), *(T.StructField(f"c{i}", T.DoubleType()) for i in range(k))])

    def make():
        symbols, hmm = shared.value.symbols(), shared.value.hmm

        def step(texts):
            total = [np.zeros(k), np.zeros((k, k)), np.zeros((size, k))]
            for grid, first in _grids(texts, symbols):
                for i in range(0, len(grid), 4096):
                    for t, x in zip(total, hmm.expected(grid[i : i + 4096], first[i : i + 4096])):
                        t += x
            # symbols from -1 down carry the starts and moves
            rows = np.vstack([total[2], total[1], total[0]])
            name = np.concatenate([np.arange(size), -2 - np.arange(k), [-1]])
            at = np.flatnonzero(rows.any(1))
            return {"symbol": name[at].tolist()} | {f"c{i}": rows[at, i].tolist() for i in range(k)}

        return step

    sums = map_batches(docs, ["text"], schema, make).groupBy("symbol").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).collect()
    emit, move, start = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k)
    for r in sums:
        v = np.array(r[1:])
        if r.symbol >= 0:
            emit[r.symbol] = v
        elif r.symbol == -1:
            start = v
        else:
            move[-2 - r.symbol] = v
    return HMM.from_counts(start, move, emit, model.prior(), weight)


def score_documents(docs: DataFrame, *, folds: int = 7, held_out: int = 2, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    A null text is empty: its only token is the end. A null doc_id is not held out and so trains. Repeated rows train and are
    scored each. Without training rows all counts are 0. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", (remainder(folds) == held_out).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    counts = stored(token_table(train), "counts")
    model = fit(train, counts, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        m = shared.value
        codes, hmm = Codes(list(m.frequent), m.suffixes), m.hmm
        n, own = len(m.frequent), len(m.own)
        inside = np.log10(m.suffix_mass)
        suffix = np.array([suffix_symbol(w, m.suffixes) for w in m.frequent], np.int64)
        # by code: frequent words, then the others by their symbols, then the end
        logs = np.log10(np.array(list(m.frequent.values()), float) + 1)
        base_of = np.concatenate([logs, np.zeros(m.suffixes), [np.log10(m.documents + 1)]])
        symbol_of = np.concatenate([np.where(np.arange(n) < own, np.arange(n), own + suffix), own + np.arange(m.suffixes + 1)]).astype(np.int64)
        inner_of = np.concatenate([np.where(np.arange(n) < own, 0.0, logs - inside[suffix]), -inside, [0.0]])
        end_known = int(m.documents > 0)
        task, row = TaskContext.get().partitionId() << 36, 0

        def step(keys, texts):
            nonlocal row
            out = {x: [] for x in ("row", "n_tokens", "known", "base", "inner", "words", "times")}
            sequences = []
            for t in texts:
                words = words_of(t)
                code = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
                rare_at = np.flatnonzero(code >= n)
                rare = Counter(map(words.__getitem__, rare_at.tolist()))
                code = np.append(code, n + m.suffixes)
                sequences.append(symbol_of[code])
                for x, v in zip(out, (task + row, len(code), len(words) - len(rare_at) + end_known, float(base_of[code].sum()), float(inner_of[code].sum()), list(rare), list(rare.values()))):
                    out[x].append(v)
                row += 1
            return {"doc_id": keys, "chain": hmm.log10(sequences)} | out

        return step

    schema = f"doc_id {kind}, row long, n_tokens long, known long, base double, inner double, chain double, words array<binary>, times array<int>"
    scored = stored(map_batches(rows, ["doc_id", "text"], schema, make), "scored")
    # words that were not broadcast: frequent ones are, so no word here is a hot key
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    joined = scored.drop("words", "times").join(found, "row", "left")
    logs, scale = F.coalesce("logs", F.lit(0.0)), float(np.log10(model.tokens + model.types + 1))
    return joined.select(
        "doc_id",
        (remainder(folds) == held_out).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("chain") + F.col("inner") + logs).alias("score"),
    )
