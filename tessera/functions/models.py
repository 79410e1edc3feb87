"""The seam for models: no provider is called here, results enter as a table or through a batch function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_retries(call: Callable[[list[str]], list[str | None]], attempts: int = 3, backoff: float = 1.0) -> Callable[[list[str]], list[str | None]]:
    """``call`` with waits of ``backoff * 2**n`` between attempts; after the last, every answer is null. RuntimeError is final and goes through."""

    def run(prompts: list[str]) -> list[str | None]:
        for n in range(attempts):
            try:
                return call(prompts)
            except RuntimeError:
                raise
            except Exception:
                if n + 1 < attempts:
                    time.sleep(backoff * 2**n)
        return [None] * len(prompts)

    return run


def complete(rows: DataFrame, prompt: str, call: Callable[[list[str]], list[str | None]], *, batch: int = 100) -> DataFrame:
    """Adds ``answer``: ``call`` on at most ``batch`` prompts at once, on the executors; a null answer leaves the rule's result in force."""
    schema = rows.withColumn("answer", F.lit(None).cast("string")).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                cut = part.iloc[at : at + batch]
                yield cut.assign(answer=call(cut[prompt].tolist()))

    return rows.mapInPandas(run, schema)


def parse_validation(answer: Column, similarity: Column) -> Column:
    """Struct of matches, coverage, confidence from a JSON answer; where it is broken: no match, no coverage, half the similarity."""
    parsed = F.from_json(answer, "matches boolean, coverage string, confidence double")
    good = parsed["coverage"].isin("full", "partial", "none") & parsed["confidence"].isNotNull()
    good = F.coalesce(good, F.lit(False))
    return F.struct(
        F.when(good, parsed["coverage"] != "none").otherwise(False).alias("matches"),
        F.when(good, parsed["coverage"]).otherwise("none").alias("coverage"),
        F.when(good, parsed["confidence"]).otherwise(F.round(similarity * 0.5, 4)).alias("confidence"),
    )


def finding_type(coverage: Column) -> Column:
    return F.when(coverage == "full", "compliant").when(coverage == "partial", "partial").otherwise("missing")


def vector_of(text: Column) -> Column:
    """``[0.1,0.2]`` to an array; null where it is broken."""
    return F.from_json(text, "array<double>")


def fixed(x: Column, places: int = 8) -> Column:
    """The number with ``places`` decimals as C's printf writes it: its exact value rounded, ties to even. The product is exact for floats, whose
    24 bits leave room for the scale; that of other doubles is rounded once. A null stays null."""
    x = x.cast("double")
    n = F.abs(F.rint(x * 10.0**places))
    long = F.least(n, F.lit(2.0**53)).cast("long")
    part = F.pmod(long, F.lit(10**places).cast("long"))
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    plain = F.concat(sign, ((long - part) / 10**places).cast("long").cast("string"), F.lit("."), F.lpad(part.cast("string"), places, "0"))
    odd = F.lower(F.regexp_replace(F.format_string(f"%.{places}f", x), "inity", ""))
    return F.when(n < 2.0**53, plain).when(x.isNotNull(), odd)  # larger ones have no decimals to round, if they are floats


def vector_text(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: fixed(x)), ","), F.lit("]"))
