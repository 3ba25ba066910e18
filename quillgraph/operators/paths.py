"""Shortest paths with the types of their edges, over an adjacency that is written once.

The search goes level by level from both ends, always from the smaller frontier; where they meet, the layers
between form a graph without cycles, and its paths are listed from the target back. Only the first `limit`
paths onwards from a node are kept a layer: what goes before a node is the same for all of them, so the first
paths of the whole are among these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.lineage import cut, scratch
from quillgraph.operators.hops import undirected

#: Frontiers of at most so many nodes become a filter of the adjacency's scan; at most so many are broadcast.
LISTED, BROADCAST = 100, 200_000


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, type in both directions, distinct and written in the order of src and dst, without self-loops.

    Ranges of (src, dst) split a hub's edges over files, and a scan for few nodes skips the others. Edges with a
    null end or type are left out.
    """
    spark, folder = edges.sparkSession, scratch(edges.sparkSession)
    whole = edges.select("src", "dst", "type").filter("src != dst AND type IS NOT NULL")
    undirected(cut(whole)).repartitionByRange("src", "dst").distinct().sortWithinPartitions("src", "dst").write.parquet(folder)
    return spark.read.parquet(folder)


def beside(adjacent: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges from the given different nodes. A small frontier reads only its part of the adjacency, a larger one
    is broadcast, and beyond that the join shuffles."""
    some = [r["node"] for r in nodes.select("node").limit(LISTED + 1).collect()]
    if len(some) <= LISTED:
        return adjacent.filter(F.col("src").isin(some))
    from_ = nodes.select(F.col("node").alias("src"))
    few = nodes.select("node").limit(BROADCAST + 1).count() <= BROADCAST
    return adjacent.join(F.broadcast(from_) if few else from_, "src", "left_semi")


def _one(adjacent: DataFrame, node: str) -> DataFrame:
    return adjacent.sparkSession.createDataFrame([(node,)], "node string")


def touching(kinds: list[tuple[DataFrame, str, str]], nodes: DataFrame) -> DataFrame:
    """src, dst, type of the edges from the given different nodes, in both directions, without an adjacency.

    kinds: frames of edges (src, dst, type) with what the ids of their two ends begin with. Only kinds that some node
    may be an end of are read. Few nodes become a filter, which goes below the joins that make the edges; more
    are joined.
    """
    def met(edges: DataFrame, end: str, prefix: str) -> DataFrame:
        own = nodes.select(F.col("node").alias(end)).filter(F.col(end).startswith(prefix))
        few = own.limit(BROADCAST + 1).count() <= BROADCAST
        return edges.join(F.broadcast(own) if few else own, end, "left_semi")

    def listed(prefix: str) -> list[str]:
        if prefix not in some:
            some[prefix] = [r["node"] for r in nodes.select("node").filter(F.col("node").startswith(prefix)).limit(LISTED + 1).collect()]
        return some[prefix]

    some: dict[str, list[str]] = {}
    out = nodes.sparkSession.createDataFrame([], "src string, dst string, type string")
    turned = lambda f: f.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    for frame, a, b in kinds:
        edges = frame.select("src", "dst", "type").filter("src != dst AND type IS NOT NULL")
        here, there = listed(a), listed(b)
        if len(here) <= LISTED and len(there) <= LISTED:
            if here or there:
                one = F.when(F.col("src").isin(here), F.struct("src", "dst", "type")) if here else F.lit(None)
                two = F.when(F.col("dst").isin(there), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")) if there else F.lit(None)
                kept = F.col("src").isin(here) | F.col("dst").isin(there)
                out = out.unionByName(edges.filter(kept).select(F.inline(F.array_compact(F.array(*(x for x, l in ((one, here), (two, there)) if l))))))
            continue
        for end, prefix, some_of in (("src", a, here), ("dst", b, there)):
            if some_of:
                of = edges.filter(F.col(end).isin(some_of)) if len(some_of) <= LISTED else met(edges, end, prefix)
                out = out.unionByName(of.select("src", "dst", "type") if end == "src" else turned(of))
    return out


def around(adjacent: DataFrame | list[tuple[DataFrame, str, str]], start: str, depth: int) -> DataFrame:
    """node, distance, kind (the least type of a last edge) of what is within depth steps, the start left out.

    adjacent is an adjacency, or frames of edges as for touching(), of which only what the search meets is read.
    """
    beside_ = touching if isinstance(adjacent, list) else beside
    frontier = seen = _one(adjacent[0][0] if isinstance(adjacent, list) else adjacent, start)
    found = None
    for k in range(1, depth + 1):
        reached = beside_(adjacent, frontier).groupBy(F.col("dst").alias("node")).agg(F.min("type").alias("kind"))
        frontier = cut(reached.join(seen, "node", "left_anti").select("node", F.lit(k).alias("distance"), "kind"))
        found = frontier if found is None else found.unionByName(frontier)
        seen = seen.unionByName(frontier.select("node"))
        if frontier.isEmpty():
            break
    return found


def layers(adjacent: DataFrame, start: str, target: str, depth: int) -> list[DataFrame] | None:
    """The nodes (node) at each distance from the start that may lie on a shortest path to the target; None if there
    is none within depth. The first and last layer are the two ends."""
    sides = [[_one(adjacent, start)], [_one(adjacent, target)]]
    if start == target:
        return [sides[0][0]]
    sizes = [1, 1]
    for _ in range(depth):
        side = 0 if sizes[0] <= sizes[1] else 1
        mine, other = sides[side], sides[1 - side]
        reached = beside(adjacent, mine[-1]).select(F.col("dst").alias("node")).distinct()
        for before in mine[-2:]:  # what is further back is no neighbour of this frontier
            reached = reached.join(before, "node", "left_anti")
        mine.append(cut(reached))
        sizes[side] = mine[-1].count()
        if not sizes[side]:
            return None
        met = cut(mine[-1].join(other[-1], "node", "left_semi"))
        if not met.isEmpty():
            return [*sides[0][:-1], met, *reversed(sides[1][:-1])]
    return None


def shortest_paths(adjacent: DataFrame, start: str, target: str, depth: int = 3, limit: int = 5) -> DataFrame:
    """nodes, types (arrays) and distance of the first shortest paths, in the order of their nodes, then types.

    Edges of different types between two nodes make different paths. The path from a node to itself has no edge. No
    row where the target is farther than depth; a depth below one gives none but that.
    """
    spark = adjacent.sparkSession
    found = layers(adjacent, start, target, depth)
    if found is None:
        return spark.createDataFrame([], "nodes array<string>, types array<string>, distance int")
    onward = spark.createDataFrame([(target, [target], [])], "node string, nodes array<string>, types array<string>")
    best = Window.partitionBy("node").orderBy("nodes", "types")
    for layer in reversed(found[:-1]):
        # Both ends lie in known layers; edges are the same both ways, so they are read from the later node.
        edges = beside(adjacent, onward.select("node").distinct()).withColumnRenamed("dst", "at")
        step = edges.join(layer.select(F.col("node").alias("at")), "at", "left_semi").join(onward.withColumnRenamed("node", "src"), "src")
        longer = step.select(F.col("at").alias("node"), F.concat(F.array("at"), "nodes").alias("nodes"), F.concat(F.array("type"), "types").alias("types"))
        onward = cut(longer.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit).drop("place"))
    return onward.select("nodes", "types", F.size("types").alias("distance"))


def spelled(paths: DataFrame) -> DataFrame:
    """distance, path and types, each as one string."""
    return paths.select("distance", F.array_join("nodes", ">").alias("path"), F.array_join("types", ">").alias("types"))
