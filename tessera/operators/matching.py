"""Clauses against a catalogue of requirements: applicability, pattern hits, TF-IDF retrieval, shortlist and evaluation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import literals, runs
from tessera.operators.shared import stored
from tessera.packs import CATALOGUE, TIER_RANK, Requirement


def applicable(catalogue: tuple[Requirement, ...], frameworks: list[str], contract_type: str, tier: str) -> tuple[Requirement, ...]:
    """Requirements of the organisation's frameworks that the contract's type and tier bring in."""
    return tuple(r for r in catalogue if r.framework in frameworks and (r.contract_types is None or contract_type in r.contract_types) and TIER_RANK.get(tier, 0) >= TIER_RANK[r.min_tier])


def applicable_rows(requirements: DataFrame, contracts: DataFrame) -> DataFrame:
    """The same for many contracts: requirements(framework, contract_types array or null, min_rank), contracts(frameworks array,
    contract_type, tier_rank). An equi-join on the framework; type and tier are tested on what it meets. Null or empty frameworks bring nothing in."""
    each = contracts.withColumn("framework", F.explode(F.array_distinct("frameworks")))
    fits = (F.col("contract_types").isNull() | F.array_contains("contract_types", F.col("contract_type"))) & (F.col("tier_rank") >= F.col("min_rank"))
    return each.join(requirements, "framework").where(fits)


def match_type(hits: Column) -> Column:
    return F.when(hits >= 2, "DIRECT_MATCH").when(hits == 1, "PARTIAL_MATCH").otherwise("NO_MATCH")


def match_confidence(hits: Column, patterns: Column) -> Column:
    ratio = hits / patterns
    return F.when(hits >= 2, F.round(0.82 + F.least(ratio * 0.13, F.lit(0.13)), 2)).when(hits == 1, F.round(0.62 + ratio * 0.16, 2)).otherwise(0.0)


def evidence(text: Column, patterns: tuple[str, ...], *, before: int = 50, after: int = 100, limit: int = 500, flags: str = "(?iu)") -> Column:
    """Snippets around the first match of each pattern, distinct, in order, joined and cut."""

    def snippet(p: str) -> Column:
        at, found = F.regexp_instr(text, F.lit(flags + p)), F.length(F.regexp_extract(text, flags + p, 0))
        begin = F.greatest(at - before, F.lit(1))
        return F.when(at > 0, F.trim(F.replace(F.substring(text, begin, at + found + after - begin), F.lit("\n"), F.lit(" "))))

    joined = F.array_join(F.array_distinct(F.array_compact(F.array(*[snippet(p) for p in patterns]))), " … ")
    return F.when(F.length(joined) > limit, F.concat(F.substring(joined, 1, limit - 3), F.lit("…"))).otherwise(joined)


def pattern_hits(text: Column, r: Requirement, flags: str = "(?iu)") -> Column:
    """How many of the requirement's patterns are in the text; none in a null."""
    return reduce(add, [F.coalesce(text.rlike(flags + p), F.lit(False)).cast("int") for p in r.patterns], F.lit(0))


def match_patterns(clauses: DataFrame, catalogue: tuple[Requirement, ...] = CATALOGUE, *, text: str = "text", keys: list[str] = ["clause_id"], with_evidence: bool = False, flags: str = "(?iu)") -> DataFrame:  # noqa: B006
    """A row for every clause and requirement: hits, match_type, match_confidence.

    Literal patterns in one scan and an explode of the per-requirement structs; no join, each pattern compiled once a task.
    """

    def entry(r: Requirement) -> Column:
        hits = pattern_hits(F.col(text), r, flags)
        fields = [F.lit(r.sr_id).alias("sr_id"), F.lit(r.framework).alias("framework"), F.lit(r.title).alias("title"), hits.alias("hits"), F.lit(len(r.patterns)).alias("n_patterns")]
        if with_evidence:
            fields.append(evidence(F.col(text), r.patterns, flags=flags).alias("evidence"))
        return F.struct(*fields)

    rows = clauses.select(*keys, F.explode(F.array(*[entry(r) for r in catalogue])).alias("m")).select(*keys, "m.*")
    return rows.withColumn("match_type", match_type(F.col("hits"))).withColumn("match_confidence", match_confidence(F.col("hits"), F.col("n_patterns")))


def match_patterns_join(clauses: DataFrame, patterns: DataFrame, *, text: str = "text", keys: list[str] = ["clause_id"]) -> DataFrame:  # noqa: B006
    """The same as a join with a pattern table (sr_id, framework, pattern) of any size, for catalogues that change at run time: clauses meet the
    patterns whose needed literals they hold (``literals``), and only patterns without such literals meet all clauses."""
    per = patterns.groupBy("sr_id").agg(F.count("*").alias("n_patterns"))
    hits = literals.pattern_hits_join(clauses, patterns, keys, text, ["sr_id", "framework"])
    return hits.join(per, "sr_id").withColumn("match_type", match_type(F.col("hits"))).withColumn("match_confidence", match_confidence(F.col("hits"), F.col("n_patterns")))


# Words that carry no topic.
STOP_WORDS = ("the", "an", "and", "or", "of", "to", "in", "for", "is", "are", "be", "by", "as", "at", "on", "with", "this", "that", "from", "it", "its", "any", "all", "may", "must", "shall", "should", "will", "not", "no", "have", "has", "been", "their", "which", "each", "per", "when", "where", "more", "than")


def token_rows(rows: DataFrame, text: str, *keys: str, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """keys + tok: runs of letters, digits and underscores in lower case that are plain a-z, two letters or more."""
    toks = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("tok")
    out = rows.select(*keys, toks).where(F.col("tok").rlike("^[a-z]{2,}$"))
    return out.where(~F.col("tok").isin(*stop_words)) if stop_words else out


def retrieval_text(r: Requirement) -> str:
    """Title twice, the patterns with spaces for their regex signs and digits, the synonyms."""
    plain = [re.sub(r"[\\|?.+*^$\[\](){}]|\d+", " ", p).strip() for p in r.patterns]
    return " ".join([r.title, r.title, *plain, *r.synonyms])


def idf(tokens: DataFrame, key: str, n_docs: int | Column) -> DataFrame:
    """tok, df, idf = ln((N + 1) / (df + 1)) + 1."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return tokens.groupBy("tok").agg(F.countDistinct(key).alias("df")).withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)


def weights(tokens: DataFrame, key: str, idf_rows: DataFrame) -> DataFrame:
    """key, tok, w: term share times idf, each row of a unit length. Tokens outside the idf table do not count and go before anything is counted.

    The share's divisor is one number for each key, which the unit length takes out again: counts are enough, and tokens are read once.
    """
    return _unit(tokens.select(key, "tok", F.lit(1).cast("long").alias("_c")), key, idf_rows)


def text_weights(rows: DataFrame, text: str, key: str, idf_rows: DataFrame, *, held: int = 400_000) -> DataFrame:
    """``weights`` of the texts' tokens. An idf table of up to ``held`` rows goes to the tasks, which count its words in whole batches of texts and
    give on a row for each text and word; with a larger one all tokens are rows of a join."""
    if idf_rows.limit(held + 1).count() > held:
        return weights(token_rows(rows, text, key, stop_words=()), key, idf_rows)
    known = rows.sparkSession.sparkContext.broadcast(idf_rows.select("tok").toArrow().column(0).combine_chunks().cast(pa.large_string()))
    kind = rows.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(known.value))
        for batch in batches:
            for at, texts in runs.slices(batch.column(1)):
                row, words = runs.runs_of(texts, plain=True, least=2)
                place = pc.index_in(words, value_set=known.value)
                here = place.is_valid().to_numpy(zero_copy_only=False)
                pair, n = np.unique(row[here] * size + place.fill_null(0).to_numpy()[here], return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + pair // size)), known.value.take(pa.array(pair % size)).cast(pa.string()), pa.array(n, pa.int64())], names=[key, "tok", "_c"])

    counted = rows.where(F.col(key).isNotNull()).select(key, F.lower(text).alias("_text")).mapInArrow(count, f"{key} {kind}, tok string, _c long")
    return _unit(counted.repartition(key), key, idf_rows)  # counts of a text, weights and what is grouped by the key later share one shuffle


def _unit(counts: DataFrame, key: str, idf_rows: DataFrame) -> DataFrame:
    raw = counts.where(F.col(key).isNotNull()).join(idf_rows.select("tok", "idf"), "tok").groupBy(key, "tok", "idf").agg(F.sum("_c").alias("c")).select(key, "tok", (F.col("c") * F.col("idf")).alias("x"))
    return raw.select(key, "tok", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)))).alias("w"))


_SLACK = 0.00005 + 1e-9  # scores are rounded to four digits before they are compared


def _bounds(queries: DataFrame, index: DataFrame, query_key: str) -> DataFrame:
    """key, tok, w of ``queries`` with ``_bound``, the most that the token adds to a score, ``_below``, the sum of the row's bounds up to this one in
    rising order, and ``_df``, the index rows of the token."""
    most = index.groupBy("tok").agg(F.max("w").alias("_most"), F.count("*").alias("_df"))
    bound = queries.join(most, "tok").withColumn("_bound", F.col("w") * F.col("_most"))
    below = F.sum("_bound").over(W.partitionBy(query_key).orderBy("_bound", "tok").rowsBetween(W.unboundedPreceding, 0))
    return bound.withColumn("_below", below).select(query_key, "tok", "w", "_bound", "_below", "_df")


def lifting(queries: DataFrame, index: DataFrame, query_key: str, *, least: float) -> DataFrame:
    """Rows of ``queries`` (key, tok, w) whose tokens can, with all less promising ones of the row, reach ``least``.

    A token adds at most w times the largest weight that the index gives it. Ordered by this bound, the tokens of a row that together stay
    below ``least`` can lift no pair over it, so every pair that reaches it shares one of the others.
    """
    return _bounds(queries, index, query_key).where(F.col("_below") >= least - _SLACK).select(query_key, "tok", "w")


def top_similar(queries: DataFrame, index: DataFrame, query_key: str, index_key: str, *, k: int = 5, least: float = 0.15, crowd: int = 100_000, wide: int = 10_000, held: int = 400_000) -> DataFrame:
    """Score, then the ``k`` best of each query over ``least``, of two weight tables (key, tok, w).

    An index of up to ``held`` rows goes to the tasks (``_scored_in_tasks``), so no pair is shuffled but the best of each query. With a larger one
    a join by token adds up the scores; both tables are stored before, so texts are read once. Tokens of more than ``wide`` index rows that can lift
    no pair over ``least`` (``lifting``) make no pairs: pairs that others have found, and that can still reach ``least``, look them up. The
    query rows of a token with more than ``crowd`` of them are dealt over several tasks, its index rows go to each of these.
    """
    index = stored(index, "index")
    if index.count() <= held:
        return _best(_scored_in_tasks(queries, index, query_key, index_key, k=k, least=least), query_key, index_key, k, least)
    asked = stored(_bounds(queries, index, query_key).withColumn("_late", (F.col("_below") < least - _SLACK) & (F.col("_df") > wide)), "asked")
    early, late = asked.where("not _late"), asked.where("_late")
    hot = F.broadcast(early.groupBy("tok").agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select("tok", F.ceil(F.col("_n") / crowd).cast("int").alias("_deals")))  # a row for ``crowd`` rows
    dealt = early.join(hot, "tok", "left").withColumn("_deal", F.pmod(F.xxhash64(query_key), F.coalesce("_deals", F.lit(1))))
    many = index.join(hot, "tok", "left").select(index_key, "tok", F.col("w").alias("_w"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_deals", F.lit(1)).cast("long") - 1)).alias("_deal"))
    score = F.sum(F.col("w") * F.col("_w"))
    pairs = dealt.select(query_key, "tok", "w", "_deal").join(many, ["tok", "_deal"]).groupBy(query_key, index_key).agg(score.alias("score"))
    if not late.isEmpty():
        more = late.groupBy(query_key).agg(F.sum("_bound").alias("_rest"), F.collect_list(F.struct("tok", "w")).alias("_more"))  # tokens of one text
        open_pairs = pairs.join(more, query_key, "left").where(F.col("score") + F.coalesce("_rest", F.lit(0.0)) >= least - _SLACK)
        each = open_pairs.select(query_key, index_key, "score", F.explode_outer("_more").alias("_m")).select(query_key, index_key, "score", F.col("_m.tok").alias("tok"), F.col("_m.w").alias("w"))
        added = each.join(index.select(index_key, "tok", F.col("w").alias("_w")), [index_key, "tok"], "left").groupBy(query_key, index_key, "score").agg(score.alias("_more"))
        pairs = added.select(query_key, index_key, (F.col("score") + F.coalesce("_more", F.lit(0.0))).alias("score"))
    return _best(pairs, query_key, index_key, k, least)


def _best(pairs: DataFrame, query_key: str, index_key: str, k: int, least: float) -> DataFrame:
    order = W.partitionBy(query_key).orderBy(F.desc("score"), F.desc(index_key))
    return pairs.withColumn("score", F.round("score", 4)).where(F.col("score") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored_in_tasks(queries: DataFrame, index: DataFrame, query_key: str, index_key: str, *, k: int, least: float, cells: int = 1 << 21) -> DataFrame:
    """query_key, index_key, score: all pairs over ``least`` that can be among a query's ``k`` best once scores are rounded.

    A query's tokens are one row; a batch of queries adds up its postings in arrays of ``cells`` numbers (or one query's index rows).
    """
    held = index.select(index_key, "tok", "w").toArrow()
    keys, words = pc.unique(held.column(0)), pc.unique(held.column(1).cast(pa.large_string()))
    place, item, w = pc.index_in(held.column(1).cast(pa.large_string()), value_set=words).to_numpy(), pc.index_in(held.column(0), value_set=keys).to_numpy(), held.column(2).to_numpy()
    order = np.argsort(place, kind="stable")
    start = np.searchsorted(place[order], np.arange(len(words) + 1))
    shared = index.sparkSession.sparkContext.broadcast((words, keys, start, item[order].astype(np.int64), w[order]))
    types = {x: (queries if x == query_key else index).schema[x].dataType.simpleString() for x in (query_key, index_key)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, start, item, weight = shared.value
        n, df = len(keys), np.diff(start)
        for batch in batches:
            lists = batch.column(1)
            parts = lists.flatten()
            place = pc.index_in(parts.field(0).cast(pa.large_string()), value_set=words)
            here = place.is_valid().to_numpy(zero_copy_only=False)
            place, w = place.fill_null(0).to_numpy()[here], parts.field(1).to_numpy()[here]
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())[here]
            many = max(1, cells // max(1, n))
            for low in range(0, len(batch) if n else 0, many):
                high = min(low + many, len(batch))
                score = np.zeros((high - low) * n)
                a, b = np.searchsorted(row, (low, high))
                ends = np.concatenate([[0], np.cumsum(df[place[a:b]])])
                at = 0
                while at < b - a:
                    end = max(at + 1, int(np.searchsorted(ends, ends[at] + cells, side="right")) - 1)
                    mine = slice(a + at, a + end)
                    size = df[place[mine]]
                    posting = np.arange(size.sum()) + np.repeat(start[place[mine]] - (ends[at:end] - ends[at]), size)
                    score += np.bincount(np.repeat((row[mine] - low) * n, size) + item[posting], np.repeat(w[mine], size) * weight[posting], len(score))
                    at = end
                score = score.reshape(-1, n)
                limit = np.full(len(score), least - _SLACK)
                if n > k:
                    limit = np.maximum(limit, np.partition(score, n - k, axis=1)[:, n - k] - 2 * _SLACK)
                q, i = np.nonzero(score >= limit[:, None])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(low + q)), keys.take(pa.array(i)), pa.array(score[q, i])], names=[query_key, index_key, "score"])

    one = queries.groupBy(query_key).agg(F.collect_list(F.struct("tok", "w")).alias("_words"))  # tokens of one text
    return one.mapInArrow(run, f"{query_key} {types[query_key]}, {index_key} {types[index_key]}, score double")


def shortlist(pattern_hits: DataFrame, similar: DataFrame, key: str, index_key: str, *, cap: int = 8) -> DataFrame:
    """All pairs with pattern hits, filled up to ``cap`` for each key by the best of the merely similar ones."""
    det = pattern_hits.select(key, index_key).distinct().withColumn("det", F.lit(True))
    both = det.join(similar.select(key, index_key, "score"), [key, index_key], "full").withColumn("det", F.coalesce("det", F.lit(False)))
    counted = both.withColumn("_n", F.sum(F.col("det").cast("int")).over(W.partitionBy(key))).withColumn("_r", F.row_number().over(W.partitionBy(key, "det").orderBy(F.desc_nulls_last("score"), F.desc(index_key))))
    return counted.where(F.col("det") | (F.col("_r") <= F.greatest(F.lit(0), F.lit(cap) - F.col("_n")))).select(key, index_key, "det", "score")


def evaluate(predicted: DataFrame, expected: DataFrame, keys: list[str], *, strict: bool = False) -> DataFrame:
    """One row of tp, fp, fn, precision, recall, f1. ``predicted`` and ``expected`` carry match_type; strict wants equal types."""
    p, e = predicted.select(*keys, F.col("match_type").alias("_p")), expected.select(*keys, F.col("match_type").alias("_e"))
    right = (F.col("_p") == F.col("_e")) if strict else F.col("_p").isNotNull()
    tp = F.col("_p").isNotNull() & F.col("_e").isNotNull() & right
    sums = p.join(e, keys, "full").agg(F.count_if(tp).alias("tp"), F.count_if(F.col("_p").isNotNull() & ~F.coalesce(tp, F.lit(False))).alias("fp"), F.count_if(F.col("_e").isNotNull() & ~F.coalesce(tp, F.lit(False))).alias("fn"))
    return prf(sums)


def prf(sums: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(queries: DataFrame, index: DataFrame, *, k: int = 10, least: float | None = None, block: int = 2048, at_once: int = 128) -> DataFrame:
    """query_id, item_id, similarity, rank: exact cosine neighbours of queries(query_id, v) among all rows of index(item_id, v).

    The queries go to the executors in blocks of about ``block``; each block meets every batch of the index in matrix products of ``at_once``
    queries, so that a worker's memory stands whatever the tables' size, and a batch gives on its ``k`` best for each query only. Null, empty and zero vectors, and those of another length, are near to nothing: they
    find and are found by none.
    """
    rows = queries.where(F.col("query_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull())).select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v"))
    spark, parts = queries.sparkSession, []

    def search(held: list) -> DataFrame:
        widths = sorted({len(r.v) for r in held})
        asked = {}
        for w in widths:
            m = np.array([r.v for r in held if len(r.v) == w])
            size = np.linalg.norm(m, axis=1)
            asked[w] = (np.array([r.query_id for r in held if len(r.v) == w])[size > 0], m[size > 0] / size[size > 0, None])
        shared = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                fine = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                begin, flat = lists.offsets.to_numpy()[:-1], lists.values
                if flat.null_count:
                    bad = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
                    fine = fine & (bad[begin + size] == bad[begin])
                flat, items = flat.to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy()
                for w, (ids, q) in shared.value.items():
                    at = np.flatnonzero(fine & (size == w))
                    m = flat[begin[at][:, None] + np.arange(w)]
                    length = np.linalg.norm(m, axis=1)
                    m, name = m[length > 0] / length[length > 0, None], items[at][length > 0]
                    for low in range(0, len(ids) if len(name) else 0, at_once):
                        score = np.round(q[low : low + at_once] @ m.T, 4)
                        order = np.lexsort((np.broadcast_to(name, score.shape), -score), axis=1)[:, :k]
                        take = np.take_along_axis(score, order, 1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[low : low + at_once], order.shape[1])), pa.array(name[order].ravel()), pa.array(take.ravel())], names=["query_id", "item_id", "similarity"])

        return index.select(F.col("item_id").cast("long").alias("item_id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "query_id long, item_id long, similarity double")

    blocks = max(1, -(-rows.count() // block))
    for b in range(blocks):
        parts.append(search(rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()))  # about ``block`` vectors
    pairs = reduce(DataFrame.unionByName, parts)
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))).where(F.col("rank") <= k)
    return ranked if least is None else ranked.where(F.col("similarity") >= least)


def contained(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", *, held: int = 16_000_000) -> DataFrame:
    """doc_key, item_key: documents that hold the whole text of an item, in any case. Null and empty items are in none.

    Items of up to ``held`` characters in all go to the tasks. An item's longest inner run of letters and digits, with other characters on both
    of its sides, is a run of each document that holds the item: only such documents are searched for it, where they are read. Items without
    an inner run of three bytes or more are tried on every document. Larger tables meet by joins (``_contained_by_joins``).
    """
    known = items.select(item_key, F.lower(text).alias("_item")).where("_item <> ''").distinct()
    if (known.agg(F.sum(F.length("_item"))).first()[0] or 0) > held:
        return _contained_by_joins(docs, items, doc_key, item_key, text)
    rows = known.toArrow()
    names, whole = rows.column(0).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(0).type), rows.column(1).to_pylist()
    leads = [runs.inner_run(t, literals.GRAM) for t in whole]
    asked = sorted({w for w in leads if w})
    of = {w: [] for w in asked}
    for i, w in enumerate(leads):
        if w:
            of[w].append(i)
    shared = docs.sparkSession.sparkContext.broadcast((names, whole, pa.array(asked, pa.large_string()), [of[w] for w in asked], [i for i, w in enumerate(leads) if not w]))
    types = {x: (docs if x == doc_key else items).schema[x].dataType.simpleString() for x in (doc_key, item_key)}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, whole, asked, of, rest = shared.value
        for batch in batches:
            for at, texts in runs.slices(batch.column(1)):
                row, words = runs.runs_of(texts, least=literals.GRAM)
                place = pc.index_in(words, value_set=asked)
                here = place.is_valid().to_numpy(zero_copy_only=False)
                pairs = np.unique(row[here] * max(1, len(asked)) + place.fill_null(0).to_numpy()[here])
                tried: dict[int, list[int]] = {r: list(rest) for r in range(len(texts))} if rest else {}
                for p in pairs.tolist():
                    tried.setdefault(p // len(asked), list(rest)).extend(of[p % len(asked)])
                found = [(at + r, i) for r, them in tried.items() if (t := texts[r].as_py()) for i in them if whole[i] in t]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in found], pa.int64())), names.take(pa.array([i for _, i in found], pa.int64()))], names=[doc_key, item_key])

    return docs.select(doc_key, F.lower(text).alias("_text")).mapInArrow(search, f"{doc_key} {types[doc_key]}, {item_key} {types[item_key]}").distinct()


def _contained_by_joins(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str) -> DataFrame:
    """An item's longest run of letters and digits stands inside some word of such a document, so the two meet by that word (``literals``) and texts
    are fetched for these pairs only. Items without a run of three or more are tried on every document.
    """
    runs = F.regexp_extract_all(literals.fold(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    known = items.select(item_key, F.lower(text).alias("_item"), F.when(longest["n"] >= literals.GRAM, longest["w"]).alias("_run")).where(F.col("_item") != "")
    pairs = literals.candidates(docs, known.where("_run is not null").select(item_key, F.array("_run").alias("parts")), [doc_key], text, item_key)
    rows, holds = docs.select(doc_key, F.lower(text).alias("_text")), F.contains("_text", F.col("_item"))
    long = rows.join(pairs, doc_key).join(known.select(item_key, "_item"), item_key).where(holds)
    short = rows.join(known.where("_run is null"), holds)
    return long.select(doc_key, item_key).unionByName(short.select(doc_key, item_key)).distinct()


def catalogue_rows(spark: SparkSession, catalogue: tuple[Requirement, ...] = CATALOGUE) -> DataFrame:
    rows = [(r.sr_id, r.control_id, r.framework, r.title, list(r.contract_types) if r.contract_types else None, TIER_RANK[r.min_tier], r.severity, list(r.patterns), retrieval_text(r)) for r in catalogue]
    return spark.createDataFrame(rows, "sr_id string, control_id string, framework string, title string, contract_types array<string>, min_rank int, severity string, patterns array<string>, retrieval_text string")
