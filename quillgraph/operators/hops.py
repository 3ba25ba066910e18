"""One- and two-hop expansions, co-occurrence and set comparison over edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_occurring(edges: DataFrame, via: str, of: str, start: str, least: int) -> DataFrame:
    """(of, shared): others that share at least `least` different partners with `start`.

    The start's edges are few, so the self-join meets on them alone.
    """
    own = edges.filter(F.col(of) == start).select(via).distinct()
    met = edges.filter(F.col(of) != start).join(own, via, "left_semi")
    return met.groupBy(of).agg(F.countDistinct(via).alias("shared")).filter(F.col("shared") >= least)


def shared_by_all(edges: DataFrame, item: str, owner: str, owners: list[str]) -> DataFrame:
    """(item, owners, in_all): the items of the given owners, and whether all of them have it."""
    rows = edges.filter(F.col(owner).isin(*owners)).groupBy(item).agg(F.countDistinct(owner).alias("owners"))
    return rows.withColumn("in_all", F.col("owners") == len(set(owners)))


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    turned = edges.select(*(F.col(dst if c == src else src if c == dst else c).alias(c) for c in edges.columns))
    return edges.unionByName(turned)


def majority(enriched, depleted):
    return F.when(enriched > depleted, "enriched").when(depleted > enriched, "depleted").otherwise("mixed")
