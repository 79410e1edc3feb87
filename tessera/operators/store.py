"""Portfolio reads and writes: tenants, latest rows, pages, comparisons, gaps, upserts, event-sourced state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.shared import ranked


@dataclass(frozen=True)
class Tables:
    """Access to one tenant's rows: every table passes through the tenant filter."""

    tables: dict[str, DataFrame]
    customer_id: object
    column: str = "customer_id"

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name].where(F.col(self.column) == F.lit(self.customer_id))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``; the order should end in a unique column."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def page(rows: DataFrame, *order: Column, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of at most 500 rows, with place (from 1) and total, the number of rows of all pages: one pass over the rows, which are
    numbered by ranges, so a page far back costs what the first one does. An empty page has no row to carry the total."""
    return ranked(rows, *order, with_total=True).where(F.col("place").between(offset + 1, offset + min(limit, 500)))


def contains_ci(column: Column, term: str) -> Column:
    """Whether the text holds ``term`` in any case; % stands for any run of characters and _ for any one, as in SQL's LIKE; nothing escapes them."""
    return F.lower(column).like("%" + term.lower().replace("\\", "\\\\") + "%")


def present(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that ``others`` has the keys of; none is repeated."""
    return rows.join(others.select(*keys), keys, "left_semi")


def missing(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``required`` whose keys are not in ``present``."""
    return required.join(present.select(*keys).distinct(), keys, "left_anti")


def upsert_skip(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows to append: the first of each key of ``incoming`` that ``existing`` lacks."""
    return missing(latest(incoming, keys, *order), existing, keys)


def number(rows: DataFrame, prefix: str, *order: Column, width: int = 3, partition: list[str] | None = None) -> DataFrame:
    """Adds ``id``: prefix and position in ``order`` within each partition, or in the whole table by ranges; to be used after filtering."""
    if not partition:
        return ranked(rows, *order, name="_place").withColumn("id", F.format_string(f"{prefix}%0{width}d", "_place")).drop("_place")
    return rows.withColumn("id", F.format_string(f"{prefix}%0{width}d", F.row_number().over(W.partitionBy(*partition).orderBy(*order))))


def compare(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that are new, resolved or unchanged."""
    b, a = before.select(column).distinct().withColumn("_b", F.lit(1)), after.select(column).distinct().withColumn("_a", F.lit(1))
    state = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "resolved").otherwise("unchanged")
    return b.join(a, column, "full").select(column, state.alias("change"))


def finding_key(*parts: Column) -> Column:
    return F.concat_ws("__", *[F.coalesce(F.lower(F.trim(p.cast("string"))), F.lit("")) for p in parts])


def current_state(events: DataFrame, key: str, state: str, *order: Column) -> DataFrame:
    """The state of each key after its last event."""
    return latest(events, [key], *order).select(key, F.col(state).alias("state"))


def reset_on_upload(events: DataFrame, key: str, state: str, upload: str, *order: Column, archived: str = "archived") -> DataFrame:
    """Adds old_status, new_status, decision: an upload of a new version sets its case back to ``uploaded`` without a decision, unless it is archived.

    One row for every upload that resets; the first event of a key has no status to reset.
    """
    old = F.lag(state).over(W.partitionBy(key).orderBy(*order))
    moved = events.withColumn("old_status", old).where((F.col(state) == upload) & F.col("old_status").isNotNull() & (F.col("old_status") != archived))
    return moved.withColumns({"new_status": F.lit("uploaded"), "decision": F.lit("none")})


def illegal_moves(events: DataFrame, rules: DataFrame, key: str, state: str, *order: Column) -> DataFrame:
    """Events whose move from the previous state is not in ``rules`` (from_state, to_state); the first event of a key is free."""
    moves = events.withColumn("from_state", F.lag(state).over(W.partitionBy(key).orderBy(*order))).withColumn("to_state", F.col(state)).where(F.col("from_state").isNotNull())
    return moves.join(F.broadcast(rules), ["from_state", "to_state"], "left_anti")  # rules: pairs of a fixed set of states


def violations(rows: DataFrame, checks: dict[str, Column], *keys: str) -> DataFrame:
    """A row for every check that a row fails; a null result passes, as in SQL CHECK."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), n) for n, c in checks.items()]))
    return rows.select(*keys, F.explode(failed).alias("violation"))


def _public(column: Column, kind: T.DataType) -> Column:
    """``column`` without fields whose names begin with an underscore, at any depth of structs, arrays and map values."""
    if isinstance(kind, T.StructType):
        fields = [_public(column[f.name], f.dataType).alias(f.name) for f in kind if not f.name.startswith("_")]
        return F.when(column.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(column, lambda x: _public(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform_values(column, lambda _, v: _public(v, kind.valueType))
    return column


def strip_internal(rows: DataFrame) -> DataFrame:
    """The rows without columns and nested fields whose names begin with an underscore."""
    return rows.select(*[_public(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema if not f.name.startswith("_")])
