"""Keyword classification of documents: contract type, data sensitivity and the vendor tier that follows from them."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.packs import CONTRACT_KEYWORDS, SENSITIVITY_KEYWORDS


def normalised(text: Column) -> Column:
    return F.translate(F.lower(text), "-_", "  ")


def keyword_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    """Distinct keywords that occur as substrings; one that holds ``-`` or ``_`` never does, as the text has lost both."""
    return reduce(add, [F.coalesce(F.contains(text, F.lit(k)), F.lit(False)).cast("int") for k in keywords], F.lit(0))


def classify(docs: DataFrame, *, text: str = "text", types: dict = CONTRACT_KEYWORDS, levels: dict = SENSITIVITY_KEYWORDS, default_level: str = "INTERNAL") -> DataFrame:
    """Adds contract_type, type_hits, total_hits, confidence and data_sensitivity; ties go to the earlier category."""
    n = normalised(F.col(text))
    scored = docs.withColumns({f"_t{i}": keyword_hits(n, k) for i, k in enumerate(types.values())} | {f"_s{i}": keyword_hits(n, k) for i, k in enumerate(levels.values())})
    top, total = F.greatest(*[F.col(f"_t{i}") for i in range(len(types))], F.lit(0)), reduce(add, [F.col(f"_t{i}") for i in range(len(types))])
    scored = scored.withColumn("type_hits", top).withColumn("total_hits", total)
    kind = reduce(lambda c, x: c.when((F.col("type_hits") > 0) & (F.col(f"_t{x[0]}") == F.col("type_hits")), x[1]), enumerate(types), F.when(F.col("total_hits") == 0, "OTHER"))
    level = reduce(lambda c, x: c.when(F.col(f"_s{x[0]}") > 0, x[1]), enumerate(levels), F.when(F.lit(False), ""))
    sure = F.least(F.lit(0.45) + F.col("type_hits") / F.col("total_hits") * 0.5 + F.least(F.col("type_hits") * 0.03, F.lit(0.20)), F.lit(0.95))
    out = scored.withColumn("contract_type", kind).withColumn("confidence", F.when(F.col("total_hits") == 0, 0.5).otherwise(F.round(sure, 2))).withColumn("data_sensitivity", level.otherwise(default_level))
    return out.drop(*[f"_t{i}" for i in range(len(types))], *[f"_s{i}" for i in range(len(levels))])


def vendor_tier(kind: Column, level: Column, *, personal: tuple[str, ...] = ("PERSONAL_DATA", "SPECIAL_CATEGORY")) -> Column:
    """The first rule that applies decides."""
    return F.when(level.isin(*personal) | kind.isin("CLOUD_HOSTING", "ICT_OUTSOURCING"), "CRITICAL").when(kind.isin("DATA_PROCESSING", "MSP"), "HIGH").when(kind == "SAAS", "MEDIUM").otherwise("LOW")
