"""Document fingerprints (13): order MinHash, whose likeness falls with edit distance, by built-in functions alone.

A text is a sequence of units (words, in parts of up to four characters), its k-mers are runs of two units, numbered by occurrence: the
second time a run stands in a text it is another element. Elements lie on a circle of 2^64 hash values. Each of ``ENTRIES`` rotations of that
circle orders them anew; the ``LEAST`` first ones after its starting point are taken, put back in their order of the text, and their k-mers hashed
together to one entry of the fingerprint. Likeness is the share of equal entries. All of it happens inside a row.

The edited texts of ``with_edits`` need each row's next row in key order. The order comes from keys alone; the text then moves once by key and
its needed beginning once more, to the row before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored

UNIT = r"[^\x20\x09-\x0D]{1,4}"
#: Entries of a fingerprint (a power of two) and elements of an entry.
ENTRIES, LEAST = 64, 2
#: Low bits of a packed number hold a place in the text (from 1), the others a hash; places from 2^24 on count as one.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
#: Equal rows of one key that one task takes; more are dealt over several.
CROWD = 2000
#: Keys that may be dealt so.
HOT_KEYS = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def _high(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _packed(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place)


def _occurrences(runs: Column) -> Column:
    """Elements (hash of k-mer and occurrence, place) in hash order, from k-mers packed with places and sorted: equal ones lie together, in text order."""
    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (_high(s[i]) != _high(s[F.greatest(i - 1, F.lit(0))])))
    lengths = lambda s, at: F.zip_with(at, F.concat(F.slice(at, 2, F.size(s)), F.array(F.size(s))), lambda p, q: q - p)
    numbers = lambda s: F.flatten(F.transform(_let(first(s), lambda at: lengths(s, at)), lambda n: F.sequence(F.lit(1), n)))
    return F.sort_array(F.zip_with(runs, numbers(runs), lambda x, o: _packed(F.xxhash64(_high(x), o), x.bitwiseAND(F.lit(PLACE)))))


def _entries(elements: Column, kmers: Column) -> Column:
    bits = 64 - (ENTRIES.bit_length() - 1)
    arc = lambda x: F.shiftright(x, bits)
    # of each arc between two starting points only the first elements can be taken
    near = F.filter(elements, lambda x, i: (i < LEAST) | (arc(x) != arc(elements[F.greatest(i - LEAST, F.lit(0))])))
    starts = F.transform(F.sequence(F.lit(-ENTRIES // 2), F.lit(ENTRIES // 2 - 1)), lambda i: F.shiftleft(i.cast("long"), bits))

    def entry(circle: Column, begin: Column) -> Column:
        places = F.sort_array(F.transform(F.slice(circle, begin, LEAST), lambda x: x.bitwiseAND(F.lit(PLACE)).cast("int")))
        return F.xxhash64(F.transform(places, lambda p: kmers[p - 1])).bitwiseAND(F.lit(0xFFFF)).cast("int")

    def all_entries(taken: Column) -> Column:
        merged = F.sort_array(F.concat(taken, starts))  # starting points have no place, so each stands before its arc's elements
        at = _let(merged, lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda j: m[j].bitwiseAND(F.lit(PLACE)) == 0))
        circle = F.concat(taken, F.slice(taken, 1, LEAST))
        return _let(circle, lambda c: F.transform(at, lambda j, i: entry(c, j - i + 1)))

    return _let(near, all_entries)


def fingerprint(text: Column) -> Column:
    """``ENTRIES`` numbers of 16 bits as array<int>. Equal texts have equal ones; all zeros for null, empty and blank texts."""
    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    kmers = lambda u: F.zip_with(u, F.slice(u, 2, F.size(u)), lambda a, b: F.xxhash64(a, b))  # the last unit stands alone
    packed = lambda k: F.sort_array(F.transform(k, lambda h, i: _packed(h, F.least(i + 1, F.lit(PLACE)).cast("long"))))
    whole = lambda k: _let(_let(packed(k), _occurrences), lambda e: _entries(e, k))
    zeros = F.array_repeat(F.lit(0), ENTRIES)
    return F.coalesce(_let(units, lambda u: F.when(F.size(u) > 0, _let(kmers(u), whole))), zeros)


def as_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(ENTRIES))


KEY = ("_id", "_none", "_hash")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(t.alias("text"), F.coalesce(F.col(key), F.lit(0)).alias("_id"), F.col(key).isNull().alias("_none"), F.xxhash64(t).alias("_hash"))


def neighbours(keys: DataFrame, deal: Column) -> DataFrame:
    """For every distinct (_none, _id, _hash): ``n`` (characters), ``deals``, and those of the row before it in this order, null keys last; the least follows the greatest.

    Rows are put in order by range partitions; what crosses from one partition to the next is one row a partition.
    """
    order = [F.col("_none"), F.col("_id"), F.col("_hash")]
    cores = keys.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(keys.withColumn("deals", deal).repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "order")
    this = F.struct(*KEY, "n", "deals")
    ends = ranged.groupBy("range").agg(F.max_by(this, F.struct(*order)).alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(W.partitionBy(F.lit(0)).orderBy("range")))  # one row a partition
    final = ends.agg(F.max_by("last", "range").alias("final"))
    ends = ends.join(F.broadcast(final), F.lit(True)).select("range", F.coalesce("before", "final").alias("before"))
    within = F.lag(this).over(W.partitionBy("range").orderBy(*order))
    return ranged.withColumn("within", within).join(F.broadcast(ends), "range").select(*KEY, "n", "deals", F.coalesce("within", "before").alias("before"))


def _to_previous(rows: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` once for each row that stands before the row's key, under that row's key and all its deals."""
    dealt = rows.select(*[F.col(f"before.{k}").alias(k) for k in KEY], F.explode(F.sequence(F.lit(0), F.col("before.deals") - 1)).alias("_deal"), *columns)
    names = dealt.columns[len(KEY) + 1 :]
    return dealt.groupBy(*KEY, "_deal").agg(*[F.first(c).alias(c) for c in names])


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_chars, edited, fingerprint, edited_fingerprint (arrays), near_edited for every row of ``docs``, and what ``with_next`` needs.

    ``edited`` is the text with its last floor(n_chars / 2) characters replaced by the first as many (or all) of the next row's text, in
    ascending order of ``key``, a whole number; the first row is next to the last one. Null texts count as empty. Rows with one key are
    in the order of their texts' hashes; rows equal in key and text are one place in the order: all have the same next row, the first one that differs.
    Null keys come last. A single row is next to itself; an empty table gives an empty table; other columns are not looked at.
    """
    rows = _keyed(docs, key, text)
    keys = stored(rows.groupBy(*KEY).agg(F.first(F.char_length("text")).cast("long").alias("n"), F.count("*").alias("copies")), "keys")
    total = keys.agg(F.sum("copies")).first()[0] or 0
    cutoff = max(CROWD, total // HOT_KEYS)
    deal = F.greatest(F.lit(1), F.ceil(F.col("copies") / cutoff)).cast("int")
    hot = keys.where(F.col("copies") > cutoff).select(*KEY, deal.alias("_deals"))  # at most HOT_KEYS rows: each has over a HOT_KEYS-th of all
    order = stored(neighbours(keys, deal), "neighbours")
    same = lambda a, b: [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in (*KEY, "_deal")]

    dealt = rows.join(F.broadcast(hot), list(KEY), "left").withColumn("_deal", F.when(F.col("_deals") > 1, F.pmod(F.monotonically_increasing_id(), F.col("_deals")).cast("int")).otherwise(0)).drop("_deals")
    places = order.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    placed = dealt.alias("r").join(places.alias("p"), same("r", "p")).select("r.*", "p.n", "p.before")
    beginnings = _to_previous(placed, F.substring("text", F.lit(1), F.floor(F.col("before.n") / 2).cast("int")).alias("beginning"))
    met = placed.alias("r").join(beginnings.alias("b"), same("r", "b")).select("r.*", "b.beginning")
    kept = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    edited = met.withColumn("edited", F.concat(kept, F.col("beginning")))
    # both branches above need the same columns, so that the text is shuffled by key once
    marked = edited.select(F.when(~F.col("_none"), F.col("_id")).alias("key"), *KEY, "_deal", "before", F.col("n").alias("n_chars"), "edited", fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return marked.withColumnRenamed("key", key).withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))


def with_next(marked: DataFrame) -> DataFrame:
    """Adds near_next, the likeness to the next row's fingerprint, to stored rows of ``with_edits``, and drops what they carry for it."""
    same = [F.col(f"r.{k}") == F.col(f"b.{k}") for k in (*KEY, "_deal")]
    following = _to_previous(marked, F.col("fingerprint").alias("_next"))
    near = marked.alias("r").join(following.alias("b"), same).select("r.*", "b._next").withColumn("near_next", likeness(F.col("fingerprint"), F.col("_next")))
    return near.drop("_next", "_deal", "before", *KEY)
