"""SimHash near-dedup with sharded BK-trees.

Fingerprints are made from every 3-word shingle of the whole text. Only distinct fingerprints are
compared. Two fingerprints at most RADIUS = 2 bits apart agree in at least two of four 16-bit blocks, so
each goes to six shards, one for each pair of blocks and its 32 bits; every linked pair meets in one.
A shard's BK-tree (children keyed by their Hamming distance to the parent) takes all its fingerprints,
and each is searched in it along the edges within the radius only. A shard of more than SHARD
fingerprints is dealt anew by two of four 8-bit blocks of its other 32 bits: the 48 bits then fixed leave
2**16 fingerprints at most, which bounds any shard. Shards emit spanning stars, not pairs. Components over
the stars come from rounds of large-star and small-star, written to the shared folder.

Cases: null texts count as empty; texts without words have fingerprint zero and link like any other;
null doc_ids form no class of their own: they get the smallest doc_id of their component, null if none
has one. Repeated rows share fingerprint and component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, own, written

RADIUS = 2
SHARD = 2048
#: Ids of documents that may be broadcast, at most.
LOOKED_UP = 500_000


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash of a lower-cased text's shingles of `size` words, as an unsigned 64-bit integer."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = pc.ascii_lower(batch.column("text").fill_null("")).cast(pa.binary())
            prints = np.array([fingerprint(b.as_py()) for b in bodies], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(prints, pa.int64())})

    return docs.select(own(docs, "doc_id").cast("long").alias("doc_id"), own(docs, "text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Built and searched for whole arrays, level by level. Nodes are fingerprints, in the order given."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        n = len(prints)
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        here, node = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        while len(here):
            d = np.bitwise_count(prints[here] ^ prints[node]).astype(np.int64)
            key = node * 65 + d
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            child = here[first]  # the first to come along an edge becomes the child
            self.parent[child], self.edge[child] = node[first], d[first]
            rest = np.ones(len(here), bool)
            rest[first] = False
            node, here = child[group[rest]], here[rest]
        keys = self.parent[1:] * 65 + self.edge[1:]
        order = np.argsort(keys, kind="stable")
        self.keys, self.child = keys[order], order + 1

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of (query number, node) at a distance of at most the radius; few queries at a time in a large tree."""
        step = max(1, (1 << 18) // max(1, len(self.prints)))
        for at in range(0, len(queries), step):
            q = np.arange(at, min(at + step, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.prints[node]).astype(np.int64)
                hit = d <= radius
                yield q[hit], node[hit]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 1))
                high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
                n = np.maximum(high - low, 0)
                q = np.repeat(q, n)
                node = self.child[np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)]


def stars(prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint of a shard the smallest one it is joined to through links within the shard."""
    tree, label = BKTree(prints), np.arange(len(prints))
    for a, b in tree.within(prints, radius):
        while True:  # labels are roots; links between different roots hook the larger to the smaller
            ra, rb = label[a], label[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while (label[label] != label).any():
                label = label[label]
    return prints[label]


def block_pairs(value: Column, width: int, tag: int = 0) -> Column:
    """Keys of the six pairs of four blocks of `width` bits: structs of the pair's number and its bits."""
    mask = (1 << width) - 1
    block = [F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit(mask)) for i in range(4)]
    return F.array(*(F.struct(F.lit(tag + k).cast("byte").alias("pair"), F.shiftleft(block[i], width).bitwiseOR(block[j]).alias("bits")) for k, (i, j) in enumerate(combinations(range(4), 2))))


def other_half(fp: Column, pair: Column) -> Column:
    """The 32 bits of fp in the two blocks that a pair leaves out."""
    block = [F.shiftrightunsigned(fp, i * 16).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    out = None
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        a, b = (x for x in range(4) if x not in (i, j))
        value = F.shiftleft(block[a], 16).bitwiseOR(block[b])
        out = F.when(pair == k, value) if out is None else out.when(pair == k, value)
    return out


def links(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """src, dst: spanning stars of the linked fingerprints of each shard (distinct: one column fp)."""
    dealt = distinct.select("fp", F.explode(block_pairs(F.col("fp"), 16)).alias("key")).select("fp", "key.pair", "key.bits")
    sizes = dealt.groupBy("pair", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = sizes.filter(F.col("n") > shard).select("pair", "bits")
    meet = dealt.join(sizes, ["pair", "bits"])
    plain = meet.filter(F.col("n") <= shard).select("fp", "pair", "bits", F.lit(0).cast("byte").alias("pair2"), F.lit(0).cast("long").alias("bits2"))
    again = (
        dealt.join(crowded, ["pair", "bits"])
        .select("fp", "pair", "bits", F.explode(block_pairs(other_half(F.col("fp"), F.col("pair")), 8, 1)).alias("key2"))
        .select("fp", "pair", "bits", F.col("key2.pair").alias("pair2"), F.col("key2.bits").alias("bits2"))
    )
    # A list has `shard` fingerprints, or 2**16 where 48 bits are fixed.
    shards = plain.unionByName(again).groupBy("pair", "bits", "pair2", "bits2").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for fps in batch.column("fps"):
                prints = np.sort(fps.values.to_numpy(zero_copy_only=False))
                root = stars(prints.view(np.uint64)).view(np.int64)
                src.append(prints[root != prints])
                dst.append(root[root != prints])
            yield pa.RecordBatch.from_pydict({"src": pa.array(np.concatenate(src)), "dst": pa.array(np.concatenate(dst))})

    return shards.mapInArrow(search, "src long, dst long").distinct()


def all_stars(edges: DataFrame) -> bool:
    """Each src has one dst, and no dst is a src: the edges name every node's root."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or out = 1 and into = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges (src, dst): alternating large-star and small-star, each round written, until
    all edges are stars."""
    edges = written(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    while not all_stars(edges):
        both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        large = large.filter("src != dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).filter("src != dst").unionByName(lowest.select(F.col("u").alias("src"), F.col("m").alias("dst")))
        after = written(small.distinct(), "edges")
        discard(edges)
        edges = after
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())


def simhash_components(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs."""
    prints = written(fingerprints(docs), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = written(components(links(classes.select("fp"), shard)), "roots")
    lows = roots.join(classes, roots["node"] == classes["fp"]).groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(lows, "root").select(F.col("node").alias("fp"), "component_id")
    # Written, so that the last join deals the documents out anew and a fingerprint that many have can be split among tasks.
    all_classes = written(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "components")
    return prints.join(all_classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id.

    Rows without doc_id cannot be named and stay; rows that share the smallest doc_id all stay.
    """
    found = simhash_components(docs)
    gone = written(found.filter("doc_id != component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    # Few ids go to every task, so that the texts stay where they are each time they are read.
    gone = F.broadcast(gone) if gone.count() <= LOOKED_UP else gone
    return docs.join(gone, own(docs, "doc_id").cast("long") == gone["gone_id"], "left_anti")
