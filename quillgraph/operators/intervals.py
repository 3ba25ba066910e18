"""Trees as intervals: numbers of a walk around the tree, so that what is below or above is a range.

`first` numbers nodes as they are entered, from 1; `last` is the number of the last node below; what is below a node
has its `first` in this range. A table that is sorted by `first` answers both directions with one scan that min and
max of its row groups prune.

Trees of at most LEVELS levels are numbered by sorting the paths from the roots, which puts a node before all that is
below it. Leaves are set aside while that halves the rest, so that paths are found on a small core, by doubling, and
handed down by one equi-join a time. Deeper trees are walked by pointer jumping: the walk enters and leaves every node,
and the arc that follows each arc is known from siblings and parents alone. Each round every arc jumps as far as the arc
it points to did, so after k rounds a pointer has passed 2**k arcs, and a tree of any depth takes about log2 of twice
its nodes rounds of one equi-join on keys that are never hot.

Cases: a parent that is no node, none, or the node itself makes a root; of several parents of an id the smallest
counts; null ids are left out. Nodes on cycles, and all below them, have no root, so the walk around them never
ends: they get no numbers and are left out, as nothing can be said to be above them. Ids are taken as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.lineage import cut

BLOCK = 64
#: Trees of more levels are walked, and at most so many nodes are a core from which no leaves are set aside.
LEVELS, CORE = 64, 20_000


def core_paths(own: DataFrame, levels: int) -> DataFrame | None:
    """id, path (from the root to id) of every node (id, parent) that has a root, by doubling; None beyond the levels.

    As nodes of some depth have nodes of every smaller depth above them, a round in which no path reaches a root
    leaves only nodes without one.
    """
    state, size = own.select("id", F.array("id").alias("path"), F.col("parent").alias("up")), 1
    done = cut(state.filter("up IS NULL"))
    open_ = state.filter("up IS NOT NULL")
    while not open_.isEmpty():
        if size >= levels:
            return None
        there = open_.unionByName(done).select(F.col("id").alias("up"), F.col("path").alias("above"), F.col("up").alias("next"))
        grown = cut(open_.join(there, "up").select("id", F.concat("above", "path").alias("path"), F.col("next").alias("up")))
        ended = grown.filter("up IS NULL")
        if ended.isEmpty():
            break
        done, open_, size = done.unionByName(ended), grown.filter("up IS NOT NULL"), 2 * size
    return done.select("id", "path")


def root_paths(own: DataFrame, levels: int, core: int = CORE) -> DataFrame | None:
    """id, parent, path of every node (id, parent) that has a root; None if a tree has more than about so many levels."""
    rest, size, aside = own, own.count(), []
    while size > core:
        inner = cut(rest.join(rest.select(F.col("parent").alias("id")).distinct(), "id", "left_semi"))
        left = inner.count()
        if 2 * left > size:
            break
        aside.append(rest)
        rest, size = inner, left
    found = core_paths(rest, levels)
    for wider in reversed(aside if found is not None else []):
        tops = wider.filter("parent IS NULL").select("id", F.array("id").alias("path"))
        above = found.select(F.col("id").alias("parent"), F.col("path").alias("above"))
        found = tops.unionByName(wider.join(above, "parent").select("id", F.concat("above", F.array("id")).alias("path")))
    return None if found is None else found.withColumn("parent", F.get("path", F.size("path") - 2))


def by_paths(paths: DataFrame) -> DataFrame:
    """id, parent, first, last, depth of the nodes with their paths.

    Nodes go backwards, so that what ends a node's range, the next node that is no deeper, comes before it: of each
    depth the last one that was met is kept, across batches and, from a row a task and depth, across tasks.
    """
    falling = F.col("path").desc()
    ordered = cut(paths.repartitionByRange(falling).sortWithinPartitions(falling).select("id", "parent", (F.size("path") - 1).alias("depth")))
    placed = ordered.withColumn("place", F.monotonically_increasing_id())
    ends = placed.groupBy(F.shiftright("place", 33).alias("task"), "depth").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("place")).orderBy("task").collect()  # a row a task and depth
    sizes: dict[int, int] = {}
    for r in ends:
        sizes[r["task"]] = sizes.get(r["task"], 0) + r["n"]
    total, depths = sum(sizes.values()), max((r["depth"] for r in ends), default=0) + 1
    begins, nearest, at, near = {}, {}, total, np.full(depths, total + 1)
    for task in sorted(sizes):
        begins[task], nearest[task] = at, near.copy()
        for r in ends:
            if r["task"] == task:
                near[r["depth"]] = at - (r["place"] & (1 << 33) - 1)
        at -= sizes[task]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, depth = batch.column("place").to_numpy(), batch.column("depth").to_numpy()
            task = int(place[0]) >> 33
            near = nearest[task].copy() if near is None else near
            first = begins[task] - (place & (1 << 33) - 1)
            last = np.empty_like(first)
            for d in np.unique(depth):
                own, ending = np.flatnonzero(depth == d), np.flatnonzero(depth <= d)
                before = np.searchsorted(ending, own) - 1
                last[own] = np.where(before < 0, near[: d + 1].min(), first[ending[before]]) - 1
            for d in np.unique(depth):
                near[d] = first[np.flatnonzero(depth == d)[-1]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("parent"), pa.array(first), pa.array(last), batch.column("depth").cast(pa.int64())], names=["id", "parent", "first", "last", "depth"])

    return placed.mapInArrow(run, "id string, parent string, first long, last long, depth long")


def siblings(rows: DataFrame) -> DataFrame:
    """up, id, after (the next id of the same up), begins (the first of its up); rows has up and id.

    Rows are sorted over all tasks, so that the children of one parent may fill many; what follows a task's last row
    is the first row of the next.
    """
    ordered = cut(rows.repartitionByRange("up", "id").sortWithinPartitions("up", "id"))
    ends = ordered.groupBy(F.spark_partition_id().alias("task")).agg(F.min(F.struct("up", "id")).alias("low"), F.max(F.struct("up", "id")).alias("high")).orderBy("task").collect()  # a row a task
    following = {a["task"]: (b["low"]["up"], b["low"]["id"]) for a, b in zip(ends, ends[1:], strict=False)}
    before = {b["task"]: a["high"]["up"] for a, b in zip(ends, ends[1:], strict=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def out(rows_: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows_, strict=True), (pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["up", "id", "after", "begins"])

        task = 0
        for batch in batches:
            made = []
            for up, id_, task in zip(*(batch.column(c).to_pylist() for c in ("up", "id", "task")), strict=True):
                begins = before.get(task) != up if held is None else held[0] != up
                if held is not None:
                    made.append((held[0], held[1], None if begins else id_, held[2]))
                held = (up, id_, begins)
            if made:
                yield out(made)
        if held is not None:
            up, id_ = following.get(task, (None, None))
            yield out([(held[0], held[1], id_ if up == held[0] else None, held[2])])

    return ordered.withColumn("task", F.spark_partition_id()).mapInArrow(run, "up string, id string, after string, begins boolean")


def known_parents(nodes: DataFrame) -> DataFrame:
    """id, parent: one row a node, whose parent is another node or null."""
    own = nodes.filter("id IS NOT NULL").groupBy(F.col("id").cast("string").alias("id")).agg(F.min(F.col("parent").cast("string")).alias("parent"))
    known = own.select(F.col("id").alias("known"))
    parent = F.when(F.col("known").isNotNull() & (F.col("known") != F.col("id")), F.col("known"))
    return cut(own.join(known, own["parent"] == known["known"], "left").select("id", parent.alias("parent")))


def labelled(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """id, parent (null for a root), first, last, depth (0 for a root) of every node (id, parent) that has a root."""
    forest = known_parents(nodes)
    paths = root_paths(forest, levels)
    return walked(forest) if paths is None else by_paths(paths)


def walked(forest: DataFrame) -> DataFrame:
    """The same for nodes whose parents are known, at any depth."""
    up = forest.select("id", F.coalesce(F.concat(F.lit("p"), "parent"), F.lit("r")).alias("up"))
    walk = cut(siblings(up))
    child = walk.filter("begins AND up != 'r'").select(F.expr("substring(up, 2)").alias("id"), F.col("id").alias("child"))
    enter = walk.select("id").join(child, "id", "left").select("id", F.lit(False).alias("leaves"), F.coalesce("child", "id").alias("to"), F.col("child").isNull().alias("to_leaves"))
    above = F.when(F.col("up") != "r", F.expr("substring(up, 2)"))
    leave = walk.select("id", F.lit(True).alias("leaves"), F.coalesce("after", above).alias("to"), F.col("after").isNull().alias("to_leaves"))
    arcs = enter.unionByName(leave).select("*", F.when(F.col("leaves"), 0).otherwise(1).cast("long").alias("nodes"), F.when(F.col("leaves"), -1).otherwise(1).cast("long").alias("net"))
    arcs, passed = cut(arcs), 1
    most = 2 * walk.count()
    while passed < most and not arcs.filter("to IS NOT NULL").isEmpty():
        for _ in range(2):  # two jumps a round: fewer writes
            there = arcs.select(F.col("id").alias("to"), F.col("leaves").alias("to_leaves"), F.col("to").alias("next"), F.col("to_leaves").alias("next_leaves"), F.col("nodes").alias("more"), F.col("net").alias("more_net"))
            none = F.lit(0).cast("long")
            arcs = arcs.join(there, ["to", "to_leaves"], "left").select(
                "id", "leaves", F.col("next").alias("to"), F.col("next_leaves").alias("to_leaves"), (F.col("nodes") + F.coalesce("more", none)).alias("nodes"), (F.col("net") + F.coalesce("more_net", none)).alias("net")
            )
        arcs, passed = cut(arcs), 4 * passed
    ended = arcs.filter("to IS NULL")
    both = ended.groupBy("id").agg(F.max(F.when(~F.col("leaves"), F.col("nodes"))).alias("from_first"), F.max(F.when(F.col("leaves"), F.col("nodes"))).alias("after_last"), F.max(F.when(~F.col("leaves"), -F.col("net"))).alias("depth"))
    total = ended.agg(F.max("nodes")).first()[0] or 0
    numbers = both.select("id", (F.lit(total) - F.col("from_first") + 1).alias("first"), (F.lit(total) - F.col("after_last")).alias("last"), "depth")
    return walk.select("id", above.alias("parent")).join(numbers, "id").select("id", "parent", "first", "last", "depth")


def write_labels(nodes: DataFrame, path: str) -> DataFrame:
    """The labels of nodes (id, parent), written so that a file holds a range of first, and read again."""
    forest = known_parents(nodes)
    paths = root_paths(forest, LEVELS)
    if paths is None:
        return write_sorted(walked(forest), path)
    labels = by_paths(paths)
    labels.write.parquet(path)  # they come in falling order
    return labels.sparkSession.read.schema(labels.schema).parquet(path)


def write_sorted(labels: DataFrame, path: str) -> DataFrame:
    """labels, written in the order of first and read again."""
    labels.repartitionByRange("first").sortWithinPartitions("first").write.parquet(path)
    return labels.sparkSession.read.schema(labels.schema).parquet(path)


def lineage_of(table: DataFrame, node: str) -> DataFrame:
    """The rows of node and of all above it, with distance (0: node itself)."""
    at = table.filter(F.col("id") == node).select("first", "depth").first()
    first, depth = (at["first"], at["depth"]) if at else (0, 0)
    return table.filter((F.col("first") <= first) & (F.col("last") >= first)).withColumn("distance", (F.lit(depth) - F.col("depth")).cast("int"))


def below(table: DataFrame, roots: list[str]) -> DataFrame:
    """The rows of the roots and of all below them: one range of first for each root that is not below another."""
    spans = sorted((r["first"], r["last"]) for r in table.filter(F.col("id").isin(roots)).select("first", "last").collect())  # the roots
    apart: list[tuple[int, int]] = []
    for a, b in spans:
        if not apart or a > apart[-1][1]:
            apart.append((a, b))
    inside: Column = F.lit(False)
    for a, b in apart:
        inside = inside | F.col("first").between(a, b)
    return table.filter(inside)


def enclosing(table: DataFrame, marked: DataFrame, block: int = BLOCK) -> DataFrame:
    """The columns of table with those of marked (above_...) for each row of marked that is the node or above it.

    An equi-join on blocks of numbers: a marked range is dealt to the blocks it overlaps, at most one for each `block`
    nodes that it holds and one more.
    """
    wide = marked.select(*(F.col(c).alias(f"above_{c}") for c in marked.columns))
    dealt = wide.withColumn("block", F.explode(F.sequence(F.expr(f"above_first div {block}"), F.expr(f"above_last div {block}"))))
    met = table.withColumn("block", F.expr(f"first div {block}")).join(dealt, "block")
    return met.filter((F.col("above_first") <= F.col("first")) & (F.col("above_last") >= F.col("first"))).drop("block")


#: The ranks that a taxon names its ancestors by; the domain counts as a kingdom.
RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species", "strain", "subspecies"]


def rank_columns(table: DataFrame, ranks: list[str] = RANKS) -> DataFrame:
    """id and a column for each rank, with the name of what is above (or the node) there; table has rank and name.

    A superkingdom is taken for a kingdom. Where a rank occurs twice above a node, the name of the topmost counts. Nodes
    pass in the order of first; of each rank the topmost node is kept until its range ends, so nothing is joined and a
    task holds a name a rank. What is open where a task begins comes from one row a task and rank.
    """
    named = F.when(F.col("name") != "", F.when(F.col("rank") == "superkingdom", "kingdom").otherwise(F.col("rank")))
    ordered = cut(table.select("id", "first", "last", "depth", "name", named.alias("rank")).repartitionByRange("first").sortWithinPartitions("first", "name")).withColumn("task", F.spark_partition_id())
    begins = {r["task"]: r["begin"] for r in ordered.groupBy("task").agg(F.min("first").alias("begin")).orderBy("task").collect()}  # a row a task
    open_: dict[int, dict[str, tuple[str, int]]] = {}
    if len(begins) > 1:
        following = dict(zip(begins, [*list(begins.values())[1:], None], strict=True))
        after = F.create_map(*(F.lit(x) for t, b in following.items() if b is not None for x in (t, b)))
        reaching = ordered.filter(F.col("rank").isin(ranks)).withColumn("after", F.element_at(after, F.col("task"))).filter(F.col("last") >= F.col("after"))
        later = F.filter(F.array(*(F.lit(b) for b in begins.values())), lambda b: (b > F.col("first")) & (b <= F.col("last")))
        for r in reaching.withColumn("begin", F.explode(later)).groupBy("begin", "rank").agg(F.min(F.struct("depth", "name", "last")).alias("top")).collect():  # a row a task and rank
            open_.setdefault(r["begin"], {})[r["rank"]] = (r["top"]["name"], r["top"]["last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[str, int]] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first, last, rank, name = batch.column("first").to_numpy(), batch.column("last").to_numpy(), batch.column("rank"), batch.column("name")
            held = dict(open_.get(begins[batch.column("task")[0].as_py()], {})) if held is None else held
            columns = [batch.column("id")]
            for r in ranks:
                names, ends, starts = [None], [0], [0]
                if r in held:
                    names, ends = [held[r][0]], [held[r][1]]
                at = np.flatnonzero(pc.fill_null(pc.equal(rank, r), False).to_numpy(zero_copy_only=False))
                for i, f, to in zip(at.tolist(), first[at].tolist(), last[at].tolist(), strict=True):
                    if f > ends[-1]:
                        names.append(name[i].as_py())
                        ends.append(to)
                        starts.append(f)
                if names[-1] is not None:
                    held[r] = (names[-1], ends[-1])
                which = np.searchsorted(starts, first, "right") - 1
                columns.append(pa.array(names, pa.string()).take(pa.array(which, mask=np.array(ends)[which] < first)))
            yield pa.RecordBatch.from_arrays(columns, names=["id", *ranks])

    return ordered.mapInArrow(run, ", ".join(["id string", *(f"`{r}` string" for r in ranks)]))
