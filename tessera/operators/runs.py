"""Runs of letters, digits and underscores of a whole batch of texts by array functions, for words that a small table knows."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the texts that are scanned at once.
_BYTES = 1 << 22


@cache
def _word_points() -> np.ndarray:
    """Which code points are of the classes L and N, or the underscore."""
    return np.fromiter((c == 0x5F or unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)


def _in_runs(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to runs of ``[\\p{L}\\p{N}_]``."""
    points = _word_points()
    inside = np.append(points[:128], np.zeros(128, bool))[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        first, a, b, c = (padded[lead + k] for k in range(4))
        a, b, c = a & 63, b & 63, c & 63
        point = np.where(first < 0xE0, (first & 31) << 6 | a, np.where(first < 0xF0, (first & 15) << 12 | a << 6 | b, (first & 7) << 18 | a << 12 | b << 6 | c))
        at = lead[points[np.minimum(point, 0x10FFFF)]]
        size = 2 + (data[at] >= 0xE0) + (data[at] >= 0xF0)
        for k in range(4):
            inside[at[size > k] + k] = True
    return inside


def _plain_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each followed by a zero byte, and where each begins; nulls are empty."""
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", "\0").cast(pa.large_string())
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    data = np.frombuffer(joined.buffers()[2], np.uint8)[: begin[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, begin


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in slices of some megabytes, each with its first row."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def runs_of(texts: pa.Array, *, plain: bool = False, least: int = 1) -> tuple[np.ndarray, pa.Array]:
    """Row and word of every run of ``least`` bytes and more; ``plain``: of those alone that are a-z throughout."""
    data, begin = _plain_text(texts)
    edges = np.flatnonzero(np.diff(_in_runs(data).view(np.int8), prepend=0, append=0))
    first, end = edges[::2], edges[1::2]
    keep = end - first >= least
    if plain:
        other = np.concatenate([[0], np.cumsum((data < 97) | (data > 122), dtype=np.int64)])
        keep &= other[end] == other[first]
    first, end = first[keep], end[keep]
    marks = np.zeros(len(data) + 1, np.int8)
    marks[first] += 1
    marks[end] -= 1
    held = data[np.cumsum(marks[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(held)))
    return np.searchsorted(begin, first, side="right") - 1, words


def inner_run(text: str, least: int) -> str | None:
    """The longest run of ``least`` bytes and more with other characters on both of its sides: a text that holds ``text`` has it as a run of its own."""
    found, inside = runs_of(pa.array([text]))[1].to_pylist(), _in_runs(np.frombuffer(text.encode(), np.uint8))
    inner = found[int(inside[0]) : len(found) - int(inside[-1])] if len(inside) else []
    return max((w for w in inner if len(w.encode()) >= least), key=lambda w: (len(w.encode()), w), default=None)
