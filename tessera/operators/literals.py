"""Patterns that are known only at run time, joined with texts by the literals that each of them needs.

A text can match a pattern only if it holds one of some literal parts (runs of letters, digits and underscores) that the pattern cannot
do without. Parts meet the corpus' distinct words by three-letter grams, words lead to the texts that hold them, and only such candidates
meet the regular expression. Patterns that need no part of three signs meet every text, which is the slow way and stays apart.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.shared import stored

GRAM = 3
_RUN = re.compile(r"\w+")


#: Capitals that are no capital of the small letter that they are taken for, and the letter that is.
_TWINS = ("\u212a\u212b\u2126\u0130\u03f4", "K\u00c5\u03a9I\u0398")


def _fold_text(t: str) -> str:
    return t.upper().translate(str.maketrans(*_TWINS)).replace("\u1e9e", "SS")


def needed_parts(pattern: str) -> list[str] | None:
    """Folded runs of word signs, of three or more, one of which every match of ``pattern`` holds; None where no such list can be told.

    The standard library's own parse of the pattern is read: of signs in a row the longest run counts, of alternatives each must have
    one, what may be absent counts for nothing.
    """
    try:
        from re import _parser as parser  # the library's parse tree

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = parser.parse(re.sub(r"^\(\?[a-zA-Z]+\)", "", pattern))
    except (re.error, OverflowError):
        return None

    def best(found: list[list[str]]) -> list[str] | None:
        """Of several lists, each of which is needed, the one whose shortest part is the longest."""
        fit = [x for x in found if x and all(len(p) >= GRAM for p in x)]
        return max(fit, key=lambda x: (min(map(len, x)), -len(x)), default=None)

    def walk(items) -> list[str] | None:
        found, run = [], ""

        def close() -> None:
            nonlocal run
            found.extend([part] for part in _RUN.findall(_fold_text(run)))
            run = ""

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
                continue
            close()
            inner = None
            if name == "SUBPATTERN":
                inner = walk(arg[-1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                inner = walk(arg[2])
            elif name == "ATOMIC_GROUP":
                inner = walk(arg)
            elif name == "BRANCH":
                each = [walk(b) for b in arg[1]]
                inner = sorted({p for e in each for p in e}) if all(each) else None
            if inner:
                found.append(inner)
        close()
        return best(found)

    return walk(tree)


def fold(text: Column) -> Column:
    """One form for all cases of a letter: signs that a case-blind pattern takes for each other have the same one."""
    return F.replace(F.translate(F.upper(text), *_TWINS), F.lit("\u1e9e"), F.lit("SS"))


def pattern_parts(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Adds parts, array or null, by ``needed_parts``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["parts"] = [needed_parts(p) if p else None for p in f[pattern]]
            yield f

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in patterns.schema)
    return patterns.mapInPandas(run, f"{schema}, parts array<string>")


def _grams(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - (GRAM - 1)), lambda i: F.substring(word, i, GRAM)))


def candidates(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str, pattern_key: str) -> DataFrame:
    """``keys``, ``pattern_key``: distinct pairs of a text and a pattern of which the text holds a word with a needed part.

    patterns: ``pattern_key``, parts. Only distinct words are cut into grams; a word of many texts is one row there.
    """
    words = texts.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(fold(F.col(text)), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)))).alias("_word"))
    vocabulary = words.where(F.length("_word") >= GRAM).select("_word").distinct()
    parts = patterns.select(pattern_key, F.explode("parts").alias("_part")).distinct()
    asked = parts.select("_part", F.substring("_part", 1, GRAM).alias("_gram")).distinct()
    met = vocabulary.select("_word", F.explode(_grams(F.col("_word"))).alias("_gram")).join(asked, "_gram").where(F.contains("_word", F.col("_part")))
    # stored, so that its size is known before the texts' words are dealt out for the join
    leads = stored(met.join(parts, "_part").select("_word", pattern_key).distinct(), "leads")
    return words.join(leads, "_word").select(*keys, pattern_key).distinct()


def pattern_hits_join(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str, group: list[str], pattern: str = "pattern") -> DataFrame:
    """``keys``, ``group``, hits: how many of a group's rows of ``patterns`` match a text; none without a hit.

    ``keys`` name a text; of repeated keys the matches add up. Null texts and patterns match nothing. Repeated rows of a group's
    pattern count each. Patterns should be case-blind or in lower case only in parts that folding leaves alone: the regular expression decides
    in any case, with its own flags.
    """
    numbered = pattern_parts(patterns.select(*group, F.col(pattern).alias("_re")).where("_re is not null").groupBy(*group, "_re").agg(F.count("*").alias("_times")), "_re").withColumn("_p", F.xxhash64("_re"))
    fast, slow = numbered.where(F.col("parts").isNotNull()), numbered.where(F.col("parts").isNull())
    known = fast.select("_p", "parts").dropDuplicates(["_p"])
    pairs = candidates(texts, known, keys, text, "_p")
    rows = texts.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    # texts are fetched for candidates only; the pattern's groups come last
    tried = rows.join(pairs, keys).join(fast.select("_p", "_re").distinct(), "_p").where(F.expr("_text rlike _re")).select(*keys, "_re")
    found = tried.join(fast.select(*group, "_re", "_times"), "_re").select(*keys, *group, "_times")
    rest = rows.join(slow.select(*group, "_re", "_times"), F.expr("_text rlike _re")).select(*keys, *group, "_times")
    return found.unionByName(rest).groupBy(*keys, *group).agg(F.sum("_times").alias("hits"))
