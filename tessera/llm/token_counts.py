"""Token counts (5): a map-side lookup in two tiers, without a shuffle of pre-tokens.

Tier one is a broadcast table of the lengths of frequent pieces (at most ``table_entries``, learned from at most ``sample_docs``
documents; it is a cache, its content never changes a count). Tier two is each worker's cache in front of the library.
"""

from __future__ import annotations

from collections import Counter
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches
from tessera.llm.pieces import CACHE_CHARS, SPECIAL, PieceTable, worker_table


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def frequent_lengths(docs: DataFrame, path: str, *, text: str = "text", sample_docs: int = 2000, sample_chars: int = 4000, table_entries: int = 32_768) -> dict[str, int]:
    """piece -> number of tokens, for the most frequent pieces of at most ``sample_docs`` times ``sample_chars`` characters.

    Only as many files are read as hold the sample. Empty for an empty table.
    """
    rows = docs.select(F.substring(text, 1, sample_chars).alias("t")).take(sample_docs)
    seen = Counter(p for r in rows for p in (r.t or "").split(" ")[1:-1])
    table = PieceTable(path, len, add)
    top = [p for p, n in seen.most_common(table_entries) if n > 1 and p and len(p) <= CACHE_CHARS and not p[0].isspace() and not p[-1].isspace() and SPECIAL not in p]
    return {p: table[p] for p in top}


def token_counts(docs: DataFrame, *, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", limit: int = 1024, sample_docs: int = 2000, table_entries: int = 32_768) -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit for every row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated rows, an empty table gives an empty table, other
    columns of ``docs`` are not looked at whatever their names.
    """
    path = tokenizer or default_tokenizer()
    # .json vocabularies are read by path on the executors too: they are part of an installed package
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text=text, sample_docs=sample_docs, table_entries=table_entries))

    def make():
        table = worker_table("length", path, len, add, shared.value)

        def step(keys, texts):
            n = []
            for t in texts:
                first, rest = table.of(t)
                n.append(first + sum(rest))
            return {"k": keys, "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n}

        return step

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs, [key, text], f"k {kind}, n_bytes long, n_tokens long", make).select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
