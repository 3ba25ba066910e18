"""Derivation, deduplication and repair of graph frames, as pure functions of old frames to new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def implicated(participates: DataFrame, linked: DataFrame, hub: int, support: int) -> DataFrame:
    """pathway_id, disease_id, support: pathways joined to diseases by at least `support` compounds, hubs left out.

    Compounds in more than `hub` pathways go before the join, which also bounds its fan-out.
    """
    degree = participates.groupBy("compound_id").agg(F.countDistinct("pathway_id").alias("n")).filter(F.col("n") <= hub)
    met = participates.join(degree.select("compound_id"), "compound_id", "left_semi").join(linked, "compound_id")
    return met.groupBy("pathway_id", "disease_id").agg(F.countDistinct("compound_id").alias("support")).filter(F.col("support") >= support)


def without_stale(stored: DataFrame, supported: DataFrame, keys: list[str]) -> DataFrame:
    """Stored edges that are still supported."""
    return stored.join(supported.select(*keys), keys, "left_semi")


def duplicate_groups(nodes: DataFrame, key: Column, id_: str) -> DataFrame:
    """key, n, ids (in order) of the keys that several nodes share; null and empty keys are left out."""
    rows = nodes.select(key.alias("key"), F.col(id_).cast("string").alias("id")).filter("key IS NOT NULL AND key != ''")
    grouped = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")), "|").alias("ids"))
    return grouped.filter("n > 1")


def keepers(nodes: DataFrame, key: str, order: list[Column], id_: str) -> DataFrame:
    """old_id, new_id: every node of a key goes to the first of its order."""
    first = Window.partitionBy(key).orderBy(*order)
    return nodes.withColumn("new_id", F.first(id_).over(first)).select(F.col(id_).alias("old_id"), "new_id")


def repointed(edges: DataFrame, ids: DataFrame, end: str) -> DataFrame:
    """Edges whose end follows an id map, made distinct; ids without an entry stay."""
    moved = edges.join(ids, F.col(end) == F.col("old_id"), "left").withColumn(end, F.coalesce("new_id", end)).drop("old_id", "new_id")
    return moved.distinct()


def collapse_plan(nodes: DataFrame, key: Column, norm: str, weight: str) -> DataFrame:
    """key, canonical, duplicates: groups of at least two normal forms; the weightiest is canonical, ties by norm."""
    rows = nodes.select(key.alias("key"), F.col(norm).alias("norm"), F.coalesce(F.col(weight), F.lit(0)).alias("weight"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "norm")))
    grouped = rows.groupBy("key").agg(order.alias("members"), F.countDistinct("norm").alias("forms")).filter("forms >= 2")
    return grouped.select("key", F.col("members")[0]["norm"].alias("canonical"), F.array_join(F.transform(F.slice("members", F.lit(2), F.size("members")), lambda m: m["norm"]), "|").alias("duplicates"))


def best_unique(candidates: DataFrame, key: str, tier: str, id_: str) -> DataFrame:
    """key and id of the best tier, where that tier names a single id; others are refused."""
    best = candidates.groupBy(key).agg(F.min(tier).alias("best"))
    top = candidates.join(best, key).filter(F.col(tier) == F.col("best"))
    return top.groupBy(key).agg(F.min(id_).alias(id_), F.countDistinct(id_).alias("n"), F.min(tier).alias(tier)).filter("n = 1").drop("n")
