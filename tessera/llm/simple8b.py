"""Simple-8b: integers in 64-bit words of a 4-bit selector and 60 bits of payload, coded and decoded with whole arrays.

Values come in runs (one for each document). A run is cut into blocks of ``BLOCK``, so a run always begins a block; every block begins a new word, and
the offsets of the blocks' first words let all blocks be coded and decoded side by side. A value of over 60 bits is an escape:
its word has selector 0 and the place among ``escapes``.
"""

from __future__ import annotations

import numpy as np

#: Selector -> (values in the word, bits of each). Fixed values of the format; selector 0 is the escape.
LAYOUT = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
BLOCK = 128
_WIDE = BLOCK + 60
_COUNT = np.array([1] + [LAYOUT[k][0] for k in range(1, 15)], np.int64)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at least 1."""
    if not len(values) or values.max() < 1 << 52:
        return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)
    return np.maximum(np.searchsorted(_POWERS, values, side="right"), 1).astype(np.uint8)


def blocks_of(lengths: np.ndarray) -> np.ndarray:
    """Blocks of runs of these lengths."""
    return -(-np.asarray(lengths, np.int64) // BLOCK)


def _places(lengths: np.ndarray, of_run: np.ndarray) -> np.ndarray:
    """Where each value stands among the places of all blocks, when blocks are ``BLOCK`` places wide."""
    first = (np.cumsum(of_run) - of_run) * BLOCK
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def encode(values: np.ndarray, lengths: np.ndarray | list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words, block_offsets (word at which each block begins), escapes; all uint64 but the offsets, uint32."""
    values = np.ascontiguousarray(values, np.uint64)
    lengths = np.array([len(values)] if lengths is None else lengths, np.int64)
    of_run = blocks_of(lengths)
    blocks = int(of_run.sum())
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[_places(lengths, of_run)] = values
    grid, wide = np.zeros((blocks, _WIDE), np.uint64), np.zeros((blocks, _WIDE), np.uint8)
    grid[:, :BLOCK], wide[:, :BLOCK] = padded.reshape(blocks, BLOCK), _widths(padded).reshape(blocks, BLOCK)
    grid, wide = grid.ravel(), wide.ravel()
    # the selector of a word that would begin at each place: the widest value of the next 1, 2, 3, ... decides
    choice, most, have = np.full(len(wide), 14, np.uint8), wide.copy(), 1
    for selector in range(13, 0, -1):
        count, bits = LAYOUT[selector]
        for j in range(have, count):
            np.maximum(most[:-j], wide[j:], out=most[:-j])
        have = count
        choice -= (most <= bits).view(np.uint8)  # what fits narrower slots fits all wider ones
    choice[wide > 60] = 0
    # words follow each other from every block's beginning
    ends = np.full(blocks, BLOCK, np.int64)
    ends[np.cumsum(of_run)[of_run > 0] - 1] = lengths[of_run > 0] - (of_run[of_run > 0] - 1) * BLOCK
    at, ends, found = np.arange(blocks) * _WIDE, np.arange(blocks) * _WIDE + ends, []
    while at.size:
        found.append(at)
        at = at + _COUNT[choice[at]]
        live = at < ends
        at, ends = at[live], ends[live]
    base = np.sort(np.concatenate(found))
    best = choice[base]
    words = best.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in LAYOUT.items():
        if (rows := np.flatnonzero(best == selector)).size:
            begin, word = base[rows], np.zeros(rows.size, np.uint64)
            for j in range(count):
                word |= grid[begin + j] << np.uint64(j * bits)
            words[rows] |= word
    escaped = np.flatnonzero(best == 0)
    words[escaped] = np.arange(escaped.size, dtype=np.uint64)
    offsets = np.searchsorted(base, np.arange(blocks) * _WIDE).astype(np.uint32)
    return words, offsets, grid[base[escaped]]


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, lengths: np.ndarray | list[int] | int) -> np.ndarray:
    """The values that ``encode`` was given, runs of these lengths one behind the other."""
    lengths = np.atleast_1d(np.asarray(lengths, np.int64))
    if not lengths.sum():
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    ahead = np.concatenate([[0], np.cumsum(_COUNT[selector])[:-1]])
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets.astype(np.int64), len(words))))
    place = ahead - ahead[offsets][block] + block * _WIDE
    out = np.zeros(len(offsets) * _WIDE, np.uint64)
    for k, (count, bits) in LAYOUT.items():
        if (rows := np.flatnonzero(selector == k)).size:
            w, p, mask = words[rows], place[rows], np.uint64((1 << bits) - 1)
            for j in range(count):
                out[p + j] = (w >> np.uint64(j * bits)) & mask
    if (rows := np.flatnonzero(selector == 0)).size:
        out[place[rows]] = escapes[words[rows].astype(np.int64)]
    return out.reshape(-1, _WIDE)[:, :BLOCK].ravel()[_places(lengths, blocks_of(lengths))]
