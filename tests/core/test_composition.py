"""Canonical composition against the standard library's."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tessera.operators import composition as C
from tessera.operators.composition import composed
from tessera.operators.segments import normalise


def texts():
    r = random.Random(3)
    letters = "aeiouyAEOUcnsz αεηιουωΑΩ х" + "éêẹüñçąǘệΐ"
    marks = [chr(c) for c in (0x300, 0x301, 0x302, 0x303, 0x304, 0x308, 0x30A, 0x31B, 0x323, 0x327, 0x328, 0x345, 0x342, 0x313, 0x5B0, 0x94D)]
    korean = [chr(c) for c in (0x1100, 0x1112, 0x1161, 0x1175, 0x11A8, 0x11C2, 0xAC00, 0xAC01, 0xD7A3)]
    odd = ["Å", "Ω", "क़", "שׁ", "̈́", "ẛ̣", "ো", "\U0001d15e", "\U0001109a\U000110ba", "ﬁ", "½", "\n", "日本", "🎉", "ẹ́̂"]
    yield from ["", None, "plain text", "́", "́á", "각", "각", "각ᆨ", "ᅡ", *odd]
    for _ in range(1500):
        yield "".join(r.choice([r.choice(letters), r.choice(marks), r.choice(marks), r.choice(korean), r.choice(odd), "x"]) for _ in range(r.randint(1, 14)))
    for c in map(chr, range(0xA0, 0x2FFF)):  # every letter of many scripts, taken apart
        if (d := unicodedata.normalize("NFD", c)) != c:
            yield d + "z" + c


def test_composition_equals_the_standard(spark):
    given = list(enumerate(texts()))
    rows = spark.createDataFrame(given, "i int, t string").repartition(4).select("i", composed(F.col("t")).alias("c")).collect()
    want = {i: t if t is None else unicodedata.normalize("NFC", t) for i, t in given}
    wrong = [(given[r.i][1], r.c, want[r.i]) for r in rows if r.c != want[r.i]]
    assert not wrong, (len(wrong), [tuple(ascii(x) for x in w) for w in wrong[:6]])


def test_the_cheap_test_misses_nothing():
    apart, classes, pairs = C._tables()
    may = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), C.MAY_CHANGE))
    touched = {p[-1] for p in pairs} | set(classes) | {c for c in apart if unicodedata.normalize("NFC", c) != c}
    assert [hex(ord(c)) for c in sorted(touched) if not may.match(c)] == []


def test_normalise_composes(spark):
    row = spark.createDataFrame([("Geschäftsführer  régime ",)], "t string").select(normalise(F.col("t")).alias("n")).first()
    assert row.n == "Geschäftsführer régime"


def test_classes_tell_plain_characters_by_one_comparison():
    """Hundreds of ranges are looked at for characters behind the first of them only."""
    import re

    from tessera.operators import composition

    for p in composition._patterns():
        first = re.match(r"\[\\x\{([0-9a-f]+)\}-\\x\{10ffff\}&&\[\\x\{([0-9a-f]+)\}", p)
        assert first and first[1] == first[2] and int(first[1], 16) >= 0x300
