"""Merges of stored and incoming rows, as full outer joins: plain files have no MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str | Column], more: dict[str, str] | None = None) -> DataFrame:
    """One row a key. A rule for each other column: keep (stored first), replace (incoming first), newest (incoming
    wherever a row came in, nulls too), union (both lists, distinct, stored first), append (moved to the end); or an
    expression of old_<c>, new_<c>, had and came (true or null). more: rules of columns that only new has."""
    more = more or {}
    a = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in rules), *(F.lit(None).alias(f"old_{c}") for c in more), F.lit(True).alias("had"))
    rules = {**rules, **more}
    b = new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in rules), F.lit(True).alias("came"))

    def column(name: str, rule: str | Column) -> Column:
        if isinstance(rule, Column):
            return rule
        o, n = F.col(f"old_{name}"), F.col(f"new_{name}")
        if rule == "keep":
            return F.coalesce(o, n)
        if rule == "replace":
            return F.coalesce(n, o)
        if rule == "newest":
            return F.when(F.col("came"), n).otherwise(o)
        if rule == "union":
            empty = F.array().cast("array<string>")
            return F.array_distinct(F.concat(F.coalesce(o, empty), F.coalesce(n, empty)))
        if rule == "append":
            empty = F.array().cast("array<string>")
            return F.when(n.isNull(), o).otherwise(F.array_append(F.array_remove(F.coalesce(o, empty), n), n))
        raise ValueError(f"unknown rule {rule}")

    state = F.when(F.col("had") & F.col("came"), "matched").when(F.col("came"), "created").otherwise("kept")
    return a.join(b, keys, "full").select(*keys, *(column(c, r).alias(c) for c, r in rules.items()), state.alias("state"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, change (added, removed, changed) of rows that differ, nulls comparing equal."""
    a = old.select(*keys, F.struct(*values).alias("a"), F.lit(1).alias("in_a"))
    b = new.select(*keys, F.struct(*values).alias("b"), F.lit(1).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("changed")
    return a.join(b, keys, "full").filter(F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("a").eqNullSafe(F.col("b"))).select(*keys, change.alias("change"))


def first_written(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The values of the first row of each key, by an explicit order column."""
    return rows.groupBy(*keys).agg(*(F.min_by(c, order).alias(c) for c in values))


def association_rules() -> dict[str, str | Column]:
    """Rules for merged(): sources and papers gather, their number counts studies, all else is as first written."""
    none = F.array().cast("array<string>")
    papers = F.size(F.array_distinct(F.concat(F.coalesce("old_pmids", none), F.coalesce("new_pmids", none)))).cast("long")
    # The one row that makes an association counts as a study, even if it names no paper.
    studies = F.when(F.col("came").isNull(), F.col("old_n_studies")).when(F.col("had").isNull() & (F.col("new_n_studies") == 1), F.lit(1).cast("long")).otherwise(papers)
    return {"direction": F.when(F.col("had"), F.col("old_direction")).otherwise(F.col("new_direction")), "sources": "union", "pmids": "union", "n_studies": studies}


def folded_associations(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key from rows (keys, source, pmid, direction, order): what they would make one after the other.

    direction is that of the first; sources and pmids in order of their first row, empty papers left out; n_studies
    how many rows there were. Values are made distinct before they meet, so a hot key brings no more than it keeps.
    """
    kinds = F.array(F.struct(F.lit("s").alias("kind"), F.col("source").alias("value")), F.struct(F.lit("p").alias("kind"), F.nullif("pmid", F.lit("")).alias("value")))
    each = rows.select(*keys, order, "direction", F.explode(kinds).alias("x")).select(*keys, order, "direction", "x.*")
    distinct = each.groupBy(*keys, "kind", "value").agg(F.min(F.struct(order, "direction")).alias("first"), F.count(F.lit(1)).alias("n"))
    ordered = lambda kind: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("value").isNotNull(), F.struct(f"first.{order}", "value")))), lambda x: x["value"])
    return distinct.groupBy(*keys).agg(F.min("first")["direction"].alias("direction"), ordered("s").alias("sources"), ordered("p").alias("pmids"), F.sum(F.when(F.col("kind") == "s", F.col("n"))).alias("n_studies"))
