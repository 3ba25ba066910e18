"""Names that are alike by the indel ratio: a join on the rare pairs of neighbouring letters.

The ratio is 2 x common subsequence / summed lengths. At a ratio of t, strings of summed length S have a common
subsequence of c = ceil(t S / 2) at least; what is outside it costs the shorter-lived pairs of letters, so they
share 3 c - S - 1 pairs at least, repeats numbered. Strings that must share k of n pairs share one of the n - k + 1
rarest of either, whatever order is the same for both. So only these meet; lengths, places in the order and the
number of shared pairs then thin the candidates before any is scored. Where the bound is not positive for some
lengths (thresholds of about 0.8 and less), single letters take the place of pairs: c of them are shared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs_bound(least: float) -> bool:
    """Whether pairs of letters serve a threshold: all strings that reach it share one at least."""
    possible = ((s, math.ceil(least * s / 2 - 1e-9)) for s in range(3, 400))
    return 1.5 * least > 1.05 and all(3 * c - s - 1 >= 1 for s, c in possible if 2 * c <= s)


def grams(value: Column, size: int) -> Column:
    """The different pieces of a size, each with its repeat number; a shorter text is a piece itself, an empty one has none."""
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - (size - 1), F.lit(1))), lambda i: value.substr(i, F.lit(size)))
    # A repeat's number is how often the piece stood before it.
    numbered = F.transform(whole, lambda x, i: F.concat(x, F.lit("\x00"), F.size(F.filter(F.slice(whole, 1, i), lambda y: y == x)).cast("string")))
    return F.when(value == "", F.array().cast("array<string>")).otherwise(numbered)


def shared_least(total: Column, least: float, size: int) -> Column:
    """How many pieces strings of a summed length share at least."""
    common = F.ceil(total * F.lit(least / 2) - F.lit(1e-9))
    return F.greatest(common if size == 1 else common * 3 - total - 1, F.lit(1)).cast("int")


def prefixes(rows: DataFrame, order: DataFrame, least: float, size: int) -> DataFrame:
    """text, n, pieces in the order, k (least shared with any text), of each different text."""
    band = (2 - least) / least
    n = F.length("text")
    each = rows.select("text", F.explode(grams(F.col("text"), size)).alias("piece")).join(order, "piece", "left")
    placed = each.groupBy("text").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))).alias("p"))
    lengths = F.sequence(F.greatest(F.ceil(n / F.lit(band) - F.lit(1e-9)), F.lit(1)).cast("int"), F.floor(n * F.lit(band) + F.lit(1e-9)).cast("int"))
    fewest = F.array_min(F.transform(lengths, lambda m: shared_least(m + n, least, size)))
    return placed.select("text", n.alias("n"), F.transform("p", lambda x: x["piece"]).alias("pieces"), fewest.alias("k"))


def candidates(terms: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """term, name: the pairs of different texts (column text of either) that may reach the threshold; none is missed."""
    size = 2 if pairs_bound(least) else 1
    band = (2 - least) / least
    t, n = terms.select("text").filter("text != ''").distinct(), names.select("text").filter("text != ''").distinct()
    order = n.select(F.explode(grams(F.col("text"), size)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))

    def posted(rows: DataFrame, p: str) -> DataFrame:
        told = prefixes(rows, order, least, size)
        first = F.slice("pieces", 1, F.size("pieces") - F.col("k") + 1)
        return told.select(F.col("text").alias(p), F.col("n").alias(f"{p}_n"), F.col("pieces").alias(f"{p}_pieces"), F.posexplode(first).alias(f"{p}_i", "piece"))

    met = posted(t, "term").join(posted(n, "name"), "piece")
    close = (F.col("term_n") <= F.col("name_n") * band + 1e-9) & (F.col("name_n") <= F.col("term_n") * band + 1e-9)
    need = shared_least(F.col("term_n") + F.col("name_n"), least, size)
    ahead = 1 + F.least(F.size("term_pieces") - 1 - F.col("term_i"), F.size("name_pieces") - 1 - F.col("name_i"))
    shared = F.size(F.array_intersect("term_pieces", "name_pieces"))
    return met.filter(close & (ahead >= need)).filter(shared >= need).select("term", "name").distinct()


def fuzzy(terms: DataFrame, names: DataFrame, least: float = 0.85) -> DataFrame:
    """term, name, id, score of the best-scoring names (columns name, id) of each term, ties included.

    Null and empty terms and names match nothing; a name with several ids gives a row each.
    """
    from quillgraph.operators.resolve import indel_ratio

    near = candidates(terms.select(F.col("term").alias("text")), names.select(F.col("name").alias("text")), least)
    scored = near.withColumn("score", indel_ratio("term", "name")).filter(F.col("score") >= least)
    best = Window.partitionBy("term").orderBy(F.col("score").desc())
    first = scored.withColumn("rank", F.rank().over(best)).filter("rank = 1").drop("rank")
    return first.join(names.select("name", "id").distinct(), "name").select("term", "name", "id", "score")
