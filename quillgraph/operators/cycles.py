"""Cycles: strongly connected components first, then a bounded search inside each of them.

Nodes with one way out are followed by doubling: what leads to a cycle of such nodes is on it or on none, and what leads
to a node without a way out is on none, so both go in about log2 of their number of rounds. The same is done with
single ways in. Where every node has one way out, nothing is left.

Of the rest, nodes without an edge in or out are trimmed level by level. Of what is left every node takes the largest key that
reaches it (forward), and what a key's own node is reached by among the nodes of its colour is its component
(backward). These go, with all edges between colours, and the rest starts anew, until no edge is left.

Rounds are stored as files: a checkpoint keeps the estimated size of its plan, and as each join multiplies both
sides' sizes, the estimates' digits would double with the rounds until the driver's memory is full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.lineage import stored


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges whose ends both have an edge in and one out, among these edges again."""
    size = edges.count()
    while size:
        both = edges.select(F.col("src").alias("node")).intersect(edges.select("dst"))
        left = stored(edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
        before, size = size, left.count()
        edges = left
        if size == before:
            break
    return edges


def coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the largest node that reaches it, itself included."""
    colours = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node"))
    moved = colours
    while not moved.isEmpty():
        sent = edges.join(moved, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("colour"))
        grown = stored(colours.join(sent.withColumnRenamed("colour", "sent"), "node", "left").select("node", F.greatest("colour", "sent").alias("colour"), (F.col("sent") > F.col("colour")).alias("grew")))
        moved, colours = grown.filter("grew").drop("grew"), grown.drop("grew")
    return colours


def single_ways(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components (node, component) that cycles of nodes with one way out make, and the edges without these nodes
    and without all that only leads to them or to a node without a way out."""
    state = stored(edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.max("dst").alias("to")).filter("n = 1").select("node", "to", F.col("node").alias("top"), F.lit(True).alias("open")))
    passed, left = 1, state.count()
    # A way of n nodes that ends has at least n - passed / 2 of them still open, so none is longer than passed in the end.
    while left and passed < 2 * left:
        there = state.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("top").alias("more"))
        state = stored(state.join(there, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.greatest("top", "more").alias("top"), F.col("next").isNotNull().alias("open")))
        passed, left = 2 * passed, state.filter("open").count()
    # What has not ended has passed as many nodes as there are: it is inside a cycle by now.
    turning = state.join(state.select(F.col("node").alias("to")), "to", "left_semi")
    found = stored(turning.join(turning.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", F.col("top").alias("component")))
    lost = state.join(edges.select(F.col("src").alias("to")).distinct(), "to", "left_anti").select("node")
    gone = stored(turning.select("node").unionByName(lost))
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("node", end), end, "left_anti")
    return found, stored(edges.select("src", "dst"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its largest node) of the strongly connected components of two nodes and more.

    Edges with a null end and self-loops do not count; repeated edges count once.
    """
    rest = stored(edges.select("src", "dst").filter("src != dst").distinct())
    out, rest = single_ways(rest)
    back, rest = single_ways(rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    out, rest = out.unionByName(back), rest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    while not (rest := trimmed(rest)).isEmpty():
        colours = coloured(rest)
        inside = stored(rest.join(colours.withColumnRenamed("node", "src"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("c")), "dst").filter("colour = c").select("src", "dst", "colour"))
        at = found = stored(colours.filter("node = colour"))
        rounds = 0
        while not at.isEmpty():
            rounds += 1
            if not rounds % 16:
                found = stored(found)  # else the plan grows with the rounds
            at = stored(inside.join(at.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct().join(found, "node", "left_anti"))
            found = found.unionByName(at)
        found = stored(found)
        out = out.unionByName(found.withColumnRenamed("colour", "component"))
        gone = found.select("node")
        rest = stored(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out.join(sizes, "component", "left_semi").select("node", "component")


def on_cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """node, length of the shortest cycle (1: a self-loop) of each node that is on one, up to a length.

    Walks stay inside components, so nodes on no cycle start none, and a node leaves the search once its cycle is
    found.
    """
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.lit(1).alias("length")).distinct()
    of = stored(components(edges))
    known = edges.select("src", "dst").filter("src != dst").distinct()
    step = stored(known.join(of.select(F.col("node").alias("src"), "component"), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").filter("component = c").select("src", "dst"))
    out = loops
    walk = step.join(loops.select(F.col("node").alias("src")), "src", "left_anti").select(F.col("src").alias("node"), F.col("dst").alias("at"))
    for k in range(2, longest + 1):
        walk = stored(walk.join(step, F.col("at") == F.col("src")).select("node", F.col("dst").alias("at")).distinct())
        closed = walk.filter("node = at").select("node", F.lit(k).alias("length"))
        out = out.unionByName(closed)
        walk = walk.join(closed.select("node"), "node", "left_anti")
    return out
