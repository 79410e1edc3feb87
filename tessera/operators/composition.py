"""Canonical composition of characters (NFC) by built-in functions.

The tables follow by rule from the standard library's character data when a plan is made: full canonical decompositions, classes of
combining marks, and the pairs that compose. Texts without marks, parted Korean syllables or characters that have another normal form stay as they
are; elsewhere each base letter with its marks is taken apart, its marks are put in canonical order and joined to it one by one.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR, _ITEM = "\x01", "\x02"
# Korean syllables: first letters, vowels and last letters by their places, as the standard defines them.
_L, _V, _T, _S, _VOWELS, _LASTS = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28
_KOREAN = "[\\u1100-\\u1112][\\u1161-\\u1175][\\u11a8-\\u11c2]?|[\\uac00-\\ud7a3][\\u11a8-\\u11c2]"


@lru_cache
def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """character -> full decomposition, mark -> its class, pair -> composed character; Korean syllables are left to arithmetic."""
    apart, classes, pairs = {}, {}, {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.combining(c):
            classes[c] = str(unicodedata.combining(c))
        d = unicodedata.normalize("NFD", c)
        if d != c and not _S <= ord(c) < _S + 11172:
            apart[c] = d
            two = unicodedata.decomposition(c).split()
            if len(two) == 2 and unicodedata.normalize("NFC", c) == c:
                pairs["".join(chr(int(x, 16)) for x in two)] = c
    return apart, classes, pairs


def _map(entries: dict[str, str]) -> Column:
    """One literal, which the optimiser turns into a map once."""
    return F.str_to_map(F.lit(_ITEM.join(f"{k}{_PAIR}{v}" for k, v in entries.items())), F.lit(_ITEM), F.lit(_PAIR))


def _signs(characters: set[str]) -> str:
    """A regular expression's class, in ranges. Characters before the first are told by one comparison, not by one for each range."""
    out, codes = [], sorted(map(ord, characters))
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    ranges = "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in out)
    return f"[\\x{{{codes[0]:x}}}-\\x{{10ffff}}&&[{ranges}]]"


def _korean(part: Column) -> Column:
    at = lambda i: F.ascii(F.substring(part, i, 1))
    whole = at(1) >= _S
    code = F.when(whole, at(1) + at(2) - _T).otherwise(_S + ((at(1) - _L) * _VOWELS + at(2) - _V) * _LASTS + F.when(F.char_length(part) > 2, at(3) - _T).otherwise(0))
    made = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
    # a syllable that already has a last letter takes no other
    return F.when(whole & ((at(1) - _S) % _LASTS != 0), part).otherwise(made)


def _cluster(part: Column) -> Column:
    apart, classes, pairs = (_map(t) for t in _tables())
    chars = F.flatten(F.transform(F.regexp_extract_all(part, F.lit("(?s)."), F.lit(0)), lambda c: F.regexp_extract_all(F.coalesce(F.element_at(apart, c), c), F.lit("(?s)."), F.lit(0))))
    ranked = F.transform(chars, lambda c, i: F.struct(F.coalesce(F.element_at(classes, c).cast("int"), F.lit(0)).alias("k"), i.alias("i"), c.alias("c")))
    # marks go by class between characters of class 0, which stand still: ``s`` numbers the stretch that such a character begins
    stretch = F.transform(ranked, lambda x, i: F.struct(F.size(F.filter(F.slice(ranked, 1, i + 1), lambda y: y["k"] == 0)).alias("s"), x["k"].alias("k"), x["i"].alias("i"), x["c"].alias("c")))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(-1).alias("last"))

    def step(s: Column, x: Column) -> Column:
        joined = F.element_at(pairs, F.concat(s["base"], x["c"]))
        free = (s["last"] < x["k"]) | (s["last"] == -1)
        joins = joined.isNotNull() & (s["base"] != "") & free
        begins = x["k"] == 0
        return (
            F.when(joins, F.struct(s["done"].alias("done"), joined.alias("base"), s["rest"].alias("rest"), s["last"].alias("last")))
            .when(begins, F.struct(F.concat(s["done"], s["base"], s["rest"]).alias("done"), x["c"].alias("base"), F.lit("").alias("rest"), F.lit(-1).alias("last")))
            .otherwise(F.struct(s["done"].alias("done"), s["base"].alias("base"), F.concat(s["rest"], x["c"]).alias("rest"), x["k"].alias("last")))
        )

    return F.aggregate(F.array_sort(stretch), start, step, lambda s: F.concat(s["done"], s["base"], s["rest"]))


#: Blocks outside which nothing composes or has another form: the cheap test before the exact one.
MAY_CHANGE = r"[\x{300}-\x{1fff}\x{2000}-\x{2001}\x{20d0}-\x{20ff}\x{2126}-\x{212b}\x{2329}-\x{232a}\x{2adc}\x{2cef}-\x{2dff}\x{302a}-\x{309a}\x{a66f}-\x{d7ff}\x{f900}-\x{fb4f}\x{fe20}-\x{fe2f}\x{10000}-\x{1ffff}\x{2f800}-\x{2fa1f}]"


@lru_cache
def _patterns() -> tuple[str, str]:
    """What follows a letter and may join it or be moved, and characters that have another normal form by themselves."""
    apart, classes, pairs = _tables()
    seconds = {p[-1] for p in pairs} | set(classes)
    others = {c for c in apart if unicodedata.normalize("NFC", c) != c}
    return _signs(seconds), _signs(others)


def composed(text: Column) -> Column:
    """The text in canonical composition. Parts that cannot change are passed on whole; a null stays null."""
    follows, others = _patterns()
    touched = f"{follows}|{others}|[\\u1161-\\u1175\\u11a8-\\u11c2]"
    pieces = f"(?s)(?:{_KOREAN})|(?:.(?={follows})|{others}|{follows})(?:{follows}|{others})*|.(?:(?!{follows}|{others}|[\\u1100-\\u1112]|[\\uac00-\\ud7a3][\\u11a8-\\u11c2]|.{follows}).)*"
    each = F.transform(F.regexp_extract_all(text, F.lit(pieces), F.lit(0)), lambda p: F.when(p.rlike(f"^(?:{_KOREAN})$"), _korean(p)).when(p.rlike(f"{follows}|{others}"), _cluster(p)).otherwise(p))
    return F.when(text.rlike(MAY_CHANGE), F.when(text.rlike(touched), F.array_join(each, "")).otherwise(text)).otherwise(text)
