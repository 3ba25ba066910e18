"""Invariants of a graph, each of which counts its violations and must be able to fail; identifiers; sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import joined_set


def invariants(nodes: DataFrame, edges: DataFrame, assoc: DataFrame) -> DataFrame:
    """invariant, violations, from one aggregation each of nodes, edges, parents and associations.

    Nodes are grouped by id once, which tells duplicates; edges are grouped by ends and type and then meet those ids,
    so that an edge counts as often as it stands. The parents are a small part of the edges, grouped by child.
    """
    n = F.count(F.lit(1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    ids = nodes.groupBy("id").agg(n.alias("n"), F.count_if(F.coalesce(F.col("name"), F.lit("")) == "").alias("nameless"))
    of_nodes = ids.agg(total("nameless").alias("nameless"), F.count_if(F.col("n") > 1).alias("duplicate_node"))
    known = nodes.select(F.col("id").alias("dst")).distinct().withColumn("known", F.lit(True))
    grouped = edges.groupBy("src", "dst", "type").agg(n.alias("n")).join(known, "dst", "left")
    of_edges = grouped.agg(total(F.when(F.col("known").isNull(), F.col("n"))).alias("dangling_edge"), F.count_if(F.col("n") > 1).alias("duplicate_edge"))
    children = edges.filter("type = 'HAS_PARENT'").groupBy("src").agg(n.alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("own"))
    of_parents = children.agg(total("own").alias("self_parent"), F.count_if(F.col("n") > 1).alias("two_parents"))
    told = F.col("direction").isin("enriched", "depleted", "altered")
    of_assoc = assoc.agg(F.count_if(F.col("n_studies") < 1).alias("negative_studies"), F.count_if(~told).alias("unknown_direction"))
    out = None
    for counted in (of_nodes, of_edges, of_parents, of_assoc):
        rows = counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("invariant"), F.col(c).alias("violations")) for c in counted.columns))).alias("v")).select("v.*")
        out = rows if out is None else out.unionAll(rows)
    return out


def id_consistency(rows: DataFrame, id_: str) -> DataFrame:
    """total, missing, repeated (identifiers that several rows have), sharing (the rows that have them)."""
    grouped = rows.groupBy(id_).agg(F.count(F.lit(1)).alias("n"))
    several = F.col(id_).isNotNull() & (F.col("n") > 1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return grouped.agg(total("n").alias("total"), total(F.when(F.col(id_).isNull(), F.col("n"))).alias("missing"), F.count_if(several).alias("repeated"), total(F.when(several, F.col("n"))).alias("sharing"))


def source_coverage(rows: DataFrame) -> DataFrame:
    """part, sources, n, with_source: of each label or type its sources, its rows, and how many name one."""
    found = rows.groupBy("part").agg(joined_set("source").alias("sources"), F.count(F.lit(1)).alias("n"), F.count("source").alias("with_source"))
    return found.withColumn("sources", F.when(F.col("with_source") > 0, F.col("sources")))
