"""Reports as Markdown and Mermaid texts: every operator gives lines with their places, ``document`` joins a key's lines to one text.

A report holds a line for each action, requirement or topic, which are few for a key; clauses are counted in it, not listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.shared import stored


def line(rows: DataFrame, key: str, text: Column, *place: Column) -> DataFrame:
    """key, place (up to four whole numbers), line."""
    held = [p.cast("long") for p in place] + [F.lit(0).cast("long")] * (4 - len(place))
    return rows.select(F.col(key).alias("key"), F.struct(*[h.alias(f"p{i}") for i, h in enumerate(held)]).alias("place"), text.alias("line"))


def document(parts: list[DataFrame], key: str) -> DataFrame:
    """key, text: the lines of all parts in the order of their places, by newlines. Lines that are null are left out."""
    lines = reduce(DataFrame.unionByName, parts).where("line is not null")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
    return lines.groupBy("key").agg(F.array_join(listed, "\n").alias("text")).withColumnRenamed("key", key)


def cells(*columns: Column) -> Column:
    """A row of a Markdown table; bars inside are written as entities, nulls are empty."""
    plain = [F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("&#124;")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *plain), F.lit(" |"))


def heads(*names: str) -> str:
    return f"| {' | '.join(names)} |\n|{'---|' * len(names)}"


def action_report(plan: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """A report for each ``key``: its actions in order, each with priority, scores, clauses, topics and a table of its evidence. plan: ``compliance.action_plan``;
    evidence: ``compliance.action_evidence``."""
    plan, n = stored(plan, "plan"), F.col("action_no")
    say = lambda text, place: line(plan, key, text, n, F.lit(place))
    cited = plan.select(key, "finding_type", "action_no").join(evidence, [key, "finding_type"])
    cited = stored(cited, "cited")
    parts = [
        line(plan.select(key).distinct(), key, F.concat(F.lit("# Action plan: "), F.col(key).cast("string")), F.lit(0)),
        say(F.format_string("\n## ACT-%03d %s", n, "finding_type"), 0),
        say(F.concat(F.lit("- Priority: "), "priority"), 1),
        say(F.format_string("- Highest score: %.2f, sum: %.2f", F.col("max_score").cast("double"), F.col("total_score").cast("double")), 2),
        say(F.format_string("- Clauses: %d", "n_clauses"), 3),
        say(F.concat(F.lit("- Topics: "), F.array_join("topics", ", ")), 4),
        line(cited.select(key, "action_no").distinct(), key, F.lit("\n" + heads("Requirement", "Framework", "Match", "Confidence", "First clause")), n, F.lit(5)),
        line(cited, key, cells(F.col("sr_id"), F.col("framework"), F.col("match_type"), F.col("confidence"), F.col("source_clause")), n, F.lit(6), F.col("place")),
    ]
    return document(parts, key)


def audit_graph(nodes: DataFrame, key: str, source: str, target: str, label: str) -> DataFrame:
    """A Mermaid graph for each ``key`` of the distinct edges of ``nodes``, in their order; names become identifiers, texts stand in quotes."""
    name = lambda c: F.regexp_replace(F.col(c).cast("string"), r"[^A-Za-z0-9]", "_")
    shown = lambda c: F.replace(F.col(c).cast("string"), F.lit('"'), F.lit("'"))
    edge = F.format_string('    %s["%s"] -->|%s| %s["%s"]', name(source), shown(source), F.coalesce(F.col(label).cast("string"), F.lit("")), name(target), shown(target))
    each = nodes.select(key, edge.alias("line")).distinct()
    whole = each.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    return whole.select(key, F.concat(F.lit("graph LR\n"), F.col("lines")).alias("text"))
