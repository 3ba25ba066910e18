"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A document's size is its number of words. Each source has a weight and, from it, a target share of all
words, capped at a multiple of what the source has; the excess goes to the others by weight. The total is
cut into equal blocks of words (about BLOCKS, more if a small source needs finer ones), and the highest
quotients weight / (2 k + 1) allot them to the sources, as whole numbers. A source's documents are dealt by
a hash to shards, whose number grows with the input, and its blocks are allotted to its shards by the same
rule on the shards' sizes. In a shard the documents stand one after the other in seeded order and are cut
into blocks; every block is taken as often as the quota covers the shard, and the rest of the quota is a
seeded choice of blocks, once more: block k is chosen if the fraction of k times the golden ratio, from a
seeded start, is below the share that the rest has. Such fractions are spread so evenly that the words
chosen are within a few blocks of the quota. A document's words count as often as their blocks are taken.

Cases: null texts have size 0; null sources form a source, ordered last; documents of size 0 are taken 0
times; repeated rows are separate documents; a text of any length is cut at the blocks' borders; an empty
table gives an empty result. A source without words has target 0. Reruns agree, as all orders come from
hashes of doc_id, source and text. Other columns are carried along by mix, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import own, written

WORD = r"[^\x20\x09-\x0D]+"
#: Least shards of a source, and words that a shard has at most, about; blocks that the whole is cut into, about;
#: the least blocks of a source for each of its shards; the most that a document is repeated.
SHARDS, SHARD, BLOCKS, FINEST, REPEATS = 64, 50_000_000, 1 << 14, 64, 3
GOLDEN = 0.6180339887498949


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: np.ndarray, weights: np.ndarray, repeats: int = REPEATS) -> np.ndarray:
    """Shares of all words by weight, at most `repeats` times the source's words, the excess shared anew."""
    total, cap = int(sizes.sum()), sizes * repeats
    open_ = np.ones(len(sizes), bool)
    out = np.zeros(len(sizes))
    while open_.any():
        left = total - int(cap[~open_].sum())
        share = left * weights / int(weights[open_].sum())
        over = open_ & (share > cap)
        if not over.any():
            out[open_] = share[open_]
            break
        open_ &= ~over
    out[~open_] = cap[~open_]
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1); ties go to the earlier one.

    A divisor that gives nearly all seats is found by bisection; the last few go by highest quotient.
    """
    votes = votes.astype(float)
    out = np.zeros(len(votes), np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return out
    low, high = 0.0, 4.0 * (seats + len(votes)) / votes.sum()  # seats for each vote: grants too few, too many
    for _ in range(80):
        mid = (low + high) / 2
        if np.floor(votes * mid + 0.5).sum() <= seats:
            low = mid
        else:
            high = mid
    out = np.floor(votes * low + 0.5).astype(np.int64)
    while out.sum() < seats:
        out[np.argmax(votes / (2 * out + 1))] += 1
    return out


def row_key(docs: DataFrame, seed: int) -> Column:
    """A seeded hash of a document's content, the same for repeated rows."""
    return F.xxhash64(F.lit(seed), own(docs, "doc_id").cast("long"), own(docs, "source").cast("string"), own(docs, "text"))


def quotas(cells: DataFrame, shards: int = SHARDS, repeats: int = REPEATS, blocks: int = BLOCKS) -> DataFrame:
    """For each source and shard with words: source_size, target, block and quota (words to take).

    cells: source, shard, size. The first step sees one row a source, the second the shards of one source.
    """

    def by_source(frames):
        rows = pd.concat(list(frames)) if (frames := list(frames)) else pd.DataFrame({"source": [], "source_size": []})
        null = rows["source"].isna()
        key = rows["source"].where(~null, "").astype(str).str.encode("utf-8")
        rows = rows.assign(_null=null, _key=key).sort_values(["_null", "_key"]).reset_index(drop=True)
        sizes, weights = rows["source_size"].to_numpy(np.int64), np.arange(len(rows)) % 3 + 1
        target = capped_targets(sizes, weights, repeats) if len(rows) else np.zeros(0)
        least = target[target > 0].min(initial=np.inf) / (FINEST * shards)
        block = max(1, int(min(sizes.sum() // blocks, least)))
        n = sainte_lague(target, int(round(target.sum() / block)) if len(rows) else 0)
        yield pd.DataFrame({"source": rows["source"], "source_size": sizes, "target": target, "block": np.int64(block), "blocks": n})

    def by_shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        size, block = group["size"].to_numpy(np.int64), int(group["block"].iloc[0])
        n = sainte_lague(size, int(group["blocks"].iloc[0]))
        quota = np.minimum(n * block, size * repeats)
        return pd.DataFrame({"source": group["source"], "shard": group["shard"], "shard_size": size, "quota": quota})

    sources = cells.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source: sums only, whatever the number of documents.
    allotted = sources.coalesce(1).mapInPandas(by_source, "source string, source_size long, target double, block long, blocks long")
    named = cells.join(allotted, cells["source"].eqNullSafe(allotted["source"])).select(cells["source"], "shard", "size", "source_size", "target", "block", "blocks")
    dealt = named.groupBy("source").applyInPandas(by_shard, "source string, shard int, shard_size long, quota long")
    return named.join(
        dealt.withColumnsRenamed({"source": "source_", "shard": "shard_"}), F.col("source").eqNullSafe(F.col("source_")) & (F.col("shard") == F.col("shard_"))
    ).select("source", "shard", "source_size", "target", "block", "shard_size", "quota")


def chosen(block: Column) -> Column:
    """Whether a block of a shard, by number, is among those taken once more; of columns start and share."""
    place = block * GOLDEN + F.col("start")
    return place - F.floor(place) < F.col("share")


def placed(docs: DataFrame, seed: int, repeats: int, blocks: int) -> DataFrame:
    """doc_id, key, size, source_size, target, taken, whole (times that all blocks are taken), at (words of its shard
    before it), block (words of one), start and share (for chosen) of each row of docs."""
    row = docs.select(own(docs, "doc_id").cast("long").alias("doc_id"), own(docs, "source").cast("string").alias("source"), size_of(own(docs, "text")).alias("size"), row_key(docs, seed).alias("key"))
    rows = written(row, "sizes")
    shards = int(max(SHARDS, (rows.agg(F.sum("size")).first()[0] or 0) // SHARD))
    rows = rows.withColumn("shard", F.pmod(F.shiftright("key", 8), F.lit(shards)).cast("int"))
    quota = quotas(rows.groupBy("source", "shard").agg(F.sum("size").alias("size")), shards, repeats, blocks)
    quota = written(quota, "quotas").withColumnsRenamed({"source": "source_", "shard": "shard_"})
    order = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    found = found.join(quota, F.col("source").eqNullSafe(F.col("source_")) & (F.col("shard") == F.col("shard_")), "left")
    full = F.col("shard_size") > 0
    whole = F.when(full, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long")
    found = found.withColumn("whole", whole).withColumn("share", F.when(full, F.col("quota") / F.col("shard_size") - F.col("whole")).otherwise(0.0))
    found = found.withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.lit(1 << 32)) / float(1 << 32))
    end = F.col("at") + F.col("size")
    words = lambda k: F.least((k + 1) * F.col("block"), end) - F.greatest(k * F.col("block"), F.col("at"))
    more = F.aggregate(F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((end - 1) / F.col("block"))), F.lit(0).cast("long"), lambda n, k: n + F.when(chosen(k), words(k)).otherwise(0))
    taken = F.col("whole") * F.col("size") + F.when((F.col("size") > 0) & (F.col("share") > 0), more).otherwise(0)
    return found.select("doc_id", "key", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), "whole", "at", "block", "start", "share")


def mixed(docs: DataFrame, seed: int = 20, repeats: int = REPEATS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs."""
    return placed(docs, seed, repeats, blocks).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, seed: int = 20, repeats: int = REPEATS, blocks: int = BLOCKS) -> DataFrame:
    """The documents of the mix, with the columns of docs: whole texts as often as all their blocks are taken, and where
    only some are taken once more one row with the words of these, joined by spaces."""
    names = docs.columns
    # Fields by number, as names may differ in case only.
    row = F.struct(*(own(docs, c).alias(f"c{i}") for i, c in enumerate(names)))
    keyed = docs.select(row_key(docs, seed).alias("key"), own(docs, "text").cast("string").alias("text"), row.alias("row"))
    plan = written(placed(docs, seed, repeats, blocks).drop("doc_id", "source_size", "target"), "plan")
    counts = plan.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    again = written(counts.filter("rows > 1").select("key"), "repeated")
    if again.isEmpty():
        both = keyed.join(plan.filter("taken > 0"), "key")
    else:  # repeated rows are numbered, so that each gets one row of the plan
        one = Window.partitionBy("key")
        single = keyed.join(again, "key", "left_anti").join(plan.filter("taken > 0"), "key")
        numbered = keyed.join(again, "key", "left_semi").withColumn("i", F.row_number().over(one.orderBy("text")))
        places = plan.join(again, "key", "left_semi").withColumn("i", F.row_number().over(one.orderBy("at"))).filter("taken > 0")
        both = single.unionByName(numbered.join(places, ["key", "i"]).drop("i"))
    more = F.col("taken") - F.col("whole") * F.col("size")
    times = F.col("whole") + F.when(more == F.col("size"), 1).otherwise(0)
    pieces = F.concat(F.array_repeat(F.lit(False), times.cast("int")), F.when((more > 0) & (more < F.col("size")), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    words = F.filter(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda _, i: chosen(F.floor((F.col("at") + i) / F.col("block"))))
    out = both.select("*", F.explode(pieces).alias("part")).withColumn("text", F.when(F.col("part"), F.array_join(words, " ")).otherwise(F.col("text")))
    columns = []
    for i, name in enumerate(names):
        own_, kind = F.col(f"row.c{i}"), docs.schema.fields[i].dataType
        if name == "text" or (name.lower() == "text" and "text" not in names):
            own_ = F.col("text").cast(kind)
        elif name == "n_chars":
            own_ = F.when(F.col("part"), F.length("text").cast(kind)).otherwise(own_)
        columns.append(own_.alias(name))
    return out.select(*columns)
