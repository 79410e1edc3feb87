"""Exact subword encoding of whole texts through a cache of space-separated pieces.

Byte-level BPE of the kind used here never joins what stands before a lone space with what follows it: the pre-tokeniser gives
the space to the word after it. So a text may be cut before every single space that has non-space characters on both
sides, and each piece (with its space) encodes by itself. Every piece that a cache lacks goes to the tokenizer library itself.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from typing import Any

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TAIL = ".,;:!?*$%&#"
SPECIAL = "<|endoftext|>"
#: Entries of a worker's cache; at this number the learned ones go and the broadcast ones stay.
CACHE_ENTRIES = 700_000
#: The same for punctuation runs and for pieces that begin lines.
SIDE_ENTRIES = 100_000
#: Longer pieces are encoded anew each time, so that the cache's bytes are bounded too.
CACHE_CHARS = 48


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


_BYTES = str.maketrans(dict(enumerate(_byte_letters())))


_SPACE = " ".translate(_BYTES)


def _plain(word: str) -> bool:
    return word.isalpha() if word.isascii() else _WORD.fullmatch(word) is not None


class Irregular(Exception):
    """A piece touches white space other than one space: the text needs the careful cut."""


class PieceTable(dict):
    """piece -> value of ``" " + piece``; misses are encoded by the library and kept.

    ``value`` makes the value from a list of ids and ``join`` adds two values.
    """

    def __init__(self, path: str, value: Callable[[list[int]], Any], join: Callable[[Any, Any], Any], frequent: dict[str, Any] | None = None):
        from tokenizers import Tokenizer

        super().__init__(frequent or {})
        self.frequent, self.value, self.join = frequent or {}, value, join
        self.tokenizer = Tokenizer.from_file(path)
        self.tails: dict[str, Any] = {}
        self.starts: dict[str, Any] = {}
        # a word of plain letters is one pre-token; its bytes may go to the library's model without the steps around it
        cut = self.tokenizer.pre_tokenizer
        plain = self.tokenizer.normalizer is None and type(self.tokenizer.model).__name__ == "BPE" and type(cut).__name__ == "ByteLevel"
        self.model = self.tokenizer.model if plain else None
        self.newline_apart = plain and not cut.add_prefix_space

    def encode(self, text: str) -> Any:
        return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode_word(self, word: str, before: str = " ") -> Any:
        """The value of a word of letters, with the space before it unless ``before`` is empty."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return self.value([t.id for t in self.model.tokenize(_SPACE + letters if before else letters)])

    def tail(self, tail: str) -> Any:
        """The value of a run of punctuation behind a letter, which is a pre-token of its own."""
        got = self.tails.get(tail)
        if got is None:
            got = self.encode(tail)
            if len(tail) <= CACHE_CHARS:
                if len(self.tails) > SIDE_ENTRIES:
                    self.tails.clear()
                self.tails[tail] = got
        return got

    def start(self, piece: str) -> Any:
        """The value of a piece that begins a line, so without a space."""
        if piece not in self.starts:
            got = self.encode_word(piece, "") if self.model and _plain(piece) else self.encode(piece)
            if len(piece) > CACHE_CHARS:
                return got
            if len(self.starts) > SIDE_ENTRIES:
                self.starts.clear()
            self.starts[piece] = got
        return self.starts[piece]

    def across_lines(self, piece: str) -> Any:
        """The value of pieces that one newline each joins: the newline is a pre-token, what follows it has no space. None where it is not so plain."""
        first, *rest = piece.split("\n")
        if not all(x and not x[0].isspace() and not x[-1].isspace() for x in (first, *rest)):
            return None
        got, newline = self[first], self.tail("\n")
        for x in rest:
            got = self.join(self.join(got, newline), self.start(x))
        return got

    def __missing__(self, piece: str) -> Any:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Irregular
        got, known = None, True
        if piece[-1] in _TAIL:
            core = piece.rstrip(_TAIL)
            if core and core[-1].isalpha() and core[-1] < "ɐ":
                known = core in self
                got = self.join(self[core], self.tail(piece[len(core) :]))
        elif self.newline_apart and "\n" in piece:
            got, known = self.across_lines(piece), False
        if got is None:
            got = self.encode_word(piece) if self.model and _plain(piece) else self.encode(" " + piece)
        # what is put together from kept parts is kept itself only when its word comes again
        if known and len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[piece] = got
        return got

    def of(self, text: str | None) -> tuple[Any, list[Any]]:
        """Values of the text's first piece and of the others, in order."""
        if not text:
            return self.value([]), []
        if SPECIAL in text:  # the library finds special strings before it splits
            return self.encode(text), []
        first, *rest = text.split(" ")
        try:
            if not first or first[0].isspace() or first[-1].isspace():
                raise Irregular
            return self.encode(first), list(map(self.__getitem__, rest))
        except Irregular:
            first, *rest = _CUT.split(text)
            return self.encode(first), [self.encode(" " + x) for x in rest]


_TABLES: dict[tuple, PieceTable] = {}


def worker_table(kind: str, path: str, value: Callable, join: Callable, frequent: dict[str, Any] | None = None) -> PieceTable:
    """The table of this Python worker; later tasks of the worker find what earlier ones learned."""
    if (kind, path) not in _TABLES:
        _TABLES[kind, path] = PieceTable(path, value, join, frequent)
    return _TABLES[kind, path]
