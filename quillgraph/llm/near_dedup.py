"""Near-dedup of whole documents by the T-occurrence search of ngram_join, over shingles of five words.

A document goes if an earlier one (by doc_id, null last) has a Jaccard similarity of at least 0.8 over shingles of
five words, or, of texts of fewer words, the same words. Letters A to Z count as small ones. What decides is that
there is an earlier similar document, so pairs need not all be made: every class of equal sets is first compared with
the earliest class of each of its short lists, which settles groups of near copies; only the lists of classes that
this leaves are merged. No pair is missed.

Cases: null texts count as empty; texts without words are never matched and stay; rows that share a doc_id,
and rows without one, don't remove each other. Repeated rows are treated alike. Texts of any length are cut whole. An
empty table gives an empty result. Other columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, own, written
from quillgraph.llm.ngram_join import BLOCK, LOOKED_UP, Index, alike_in_length, enough_follow, entries_for, indexed, merged, rows_of

SIZE, PERCENT = 5, 80


def head_pairs(index: Index) -> DataFrame:
    """id, other: each class with the earliest class of each of its lists, where they may be similar."""
    heads = index.posts.filter("entries > 0").select("p", F.col("dk").alias("x_dk"), F.col("id").alias("other"), F.col("n").alias("m"), F.col("place").alias("there"))
    met = index.posts.filter("entries = 0").join(heads, "p").filter((F.col("x_dk") < F.col("dk")) & alike_in_length(index.percent, "n", "m"))
    return met.filter(enough_follow(index.percent, F.col("n"), F.col("place"), F.col("m"), F.col("there"))).select("id", "other").distinct()


def open_entries(index: Index, settled: DataFrame) -> DataFrame:
    """For the lists of classes that are not settled, the earlier entries that may be similar."""
    few = F.broadcast(settled) if settled.count() <= LOOKED_UP else settled
    posts = index.posts.drop("entries")
    # Lists of one block need no count.
    many = index.posts.filter(F.col("entries") > BLOCK).select("p", "entries")
    entries = posts.join(many, "p", "left").withColumn("entries", F.coalesce("entries", F.lit(1)))
    fits = lambda x: (
        (x["dk"] < F.col("dk"))
        & (F.col("n") * 100 >= x["n"] * index.percent)
        & (x["n"] * 100 >= F.col("n") * index.percent)
        & enough_follow(index.percent, F.col("n"), F.col("place"), x["n"], x["place"])
    )
    return entries_for(posts.join(few, "id", "left_anti"), entries, fits)


def keep_no_near_copies(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that an earlier document makes go."""
    plain = docs.select(own(docs, "doc_id").alias("doc_id"), own(docs, "text").alias("text"), F.struct(*(own(docs, c) for c in docs.columns)).alias("whole"))
    index = indexed(plain, size, percent, ranked=True)
    tried = written(head_pairs(index), "heads")
    near = index.similar(tried)
    settled = written(near.select(F.col("src").alias("id")).distinct(), "settled")
    found = merged(open_entries(index, settled), percent, index.partitions)
    more = written(found.join(tried, ["id", "other"], "left_anti"), "candidates")
    far = index.similar(more)
    # The later of two is src: a class goes as a whole if an earlier one is similar, else all but its first document.
    late = near.union(far).select(F.col("src").alias("id")).distinct().withColumn("late", F.lit(True))
    fate = index.classes.select("id", "a", "b", F.col("dk").alias("first")).join(late, "id", "left")
    gone = index.every.select("dk", "th", "a", "b").join(fate, ["a", "b"]).filter(F.col("late") | (F.col("dk") > F.col("first"))).select("dk", "th").distinct()
    gone = written(gone, "gone")
    for done in (index.every, index.classes, index.posts, tried, near, settled, more, far):
        discard(done)
    return rows_of(plain, "whole").join(gone, ["dk", "th"], "left_anti").select("whole.*")
