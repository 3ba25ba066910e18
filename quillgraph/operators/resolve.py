"""Entity resolution: identifiers, names, fuzzy names, ambiguity; same-as proposals and mapped rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.fuzzy import fuzzy

#: Nodes in a list, by which classes of equal tokens are paired.
LIST = 1000


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows of the dynamic programme."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & places.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """2 x common subsequence / summed lengths; two empty strings are equal. Arrow batches, not rows, reach Python."""

    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([2 * common_subsequence(p, q) / (len(p) + len(q)) if p or q else 1.0 for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(score, "double")(a, b)


def resolved(terms: DataFrame, nodes: DataFrame, is_id: Column, least: float = 0.85) -> DataFrame:
    """term, id, score, tier, status: id terms match ids only; names match case-folded, else fuzzily; several best
    matches make a term ambiguous, none unresolved."""
    known = nodes.select("id", F.lower("name").alias("name")).distinct()
    asked = terms.select("term").distinct().withColumn("is_id", is_id)
    by_id = asked.filter("is_id").join(known.select("id").distinct(), F.col("term") == F.col("id")).select("term", "id", F.lit(1.0).alias("score"), F.lit("EXTRACTED").alias("tier"))
    names = asked.filter("NOT is_id AND term != ''").select("term", F.lower("term").alias("low"))
    by_name = names.join(known, F.col("low") == F.col("name")).select("term", "id", F.lit(0.95).alias("score"), F.lit("INFERRED").alias("tier"))
    rest = names.join(by_name.select("term").distinct(), "term", "left_anti")
    close = fuzzy(rest.select(F.col("low").alias("term")), known, least)
    by_fuzz = rest.join(close.withColumnRenamed("term", "low"), "low").select("term", "id", "score", F.lit("INFERRED").alias("tier"))
    hits = by_id.unionByName(by_name).unionByName(by_fuzz)
    best = hits.groupBy("term").agg(F.min("id").alias("id"), F.max("score").alias("score"), F.first("tier").alias("tier"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return asked.join(best, "term", "left").select("term", "id", "score", F.when(F.col("n") > 1, "AMBIGUOUS").otherwise(F.col("tier")).alias("tier"), status.alias("status"))


def same_as(a: DataFrame, b: DataFrame) -> DataFrame:
    """label, a_id, b_id, shared: nodes of one label in two snapshots that share an identity token but not the id.

    a, b: label, id, tokens (array of strings). Nodes of one label with the same tokens are a class; classes meet on their
    tokens, and pairs of classes are spelled out last, a list of about LIST nodes by another, so that no pair of
    nodes is grouped or shuffled.
    """

    def classed(nodes: DataFrame) -> DataFrame:
        return nodes.filter("id IS NOT NULL").select("label", "id", F.explode("tokens").alias("token")).groupBy("label", "id").agg(F.sort_array(F.collect_set("token")).alias("tokens"))

    def lists(of: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        sizes = of.groupBy("label", "tokens").agg((F.count(F.lit(1)) / LIST + 1).cast("long").alias("lists"))
        dealt = of.join(sizes, ["label", "tokens"]).withColumn("list", F.pmod(F.xxhash64("id"), "lists"))
        named = dealt.groupBy("label", F.col("tokens").alias(f"{side}_tokens"), F.col("list").alias(f"{side}_list")).agg(F.collect_list("id").alias(f"{side}_ids"))
        return sizes.select("label", F.col("tokens").alias(f"{side}_tokens"), F.col("lists").alias(f"{side}_lists")), named

    (a_classes, a_lists), (b_classes, b_lists) = lists(classed(a), "a"), lists(classed(b), "b")
    pairs = a_classes.withColumn("token", F.explode("a_tokens")).join(b_classes.withColumn("token", F.explode("b_tokens")), ["label", "token"]).drop("token").distinct()
    numbers = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{side}_lists") - 1)).alias(f"{side}_list")
    pairs = pairs.select("label", "a_tokens", "b_tokens", "b_lists", numbers("a")).select("label", "a_tokens", "b_tokens", "a_list", numbers("b"))
    met = pairs.join(a_lists, ["label", "a_tokens", "a_list"]).join(b_lists, ["label", "b_tokens", "b_list"])
    shared = F.array_join(F.sort_array(F.array_intersect("a_tokens", "b_tokens")), "|").alias("shared")
    spelled = met.select("label", shared, "b_ids", F.explode("a_ids").alias("a_id")).select("label", "a_id", F.explode("b_ids").alias("b_id"), "shared")
    return spelled.filter("a_id != b_id")


def entities(rows: DataFrame, label: Column, id_: Column, properties: dict[str, Column], order: str) -> DataFrame:
    """One entity a (label, id): of each property the value of the last row that has one."""
    keyed = rows.select(label.alias("label"), id_.cast("string").alias("id"), order, *(v.alias(k) for k, v in properties.items())).filter("id IS NOT NULL AND id != ''")
    return keyed.groupBy("label", "id").agg(*(F.max_by(k, F.when(F.col(k).isNotNull(), F.col(order))).alias(k) for k in properties))


def relations(rows: DataFrame, type_: str, src: Column, dst: Column, value: Column, order: str) -> DataFrame:
    """One edge a (type, src, dst): the first row's."""
    keyed = rows.select(F.lit(type_).alias("type"), src.alias("src"), dst.alias("dst"), value.alias("value"), order).filter("src IS NOT NULL AND dst IS NOT NULL")
    return keyed.groupBy("type", "src", "dst").agg(F.min_by("value", order).alias("value"))


def routed(conditions: list[tuple[Column, str]], default: str) -> Column:
    """The destination of the first rule that matches."""
    out = None
    for condition, destination in conditions:
        out = F.when(condition, destination) if out is None else out.when(condition, destination)
    return F.lit(default) if out is None else out.otherwise(default)


KNOWN_CONDITIONS = ("tier", "sensitivity", "contributor", "min_rows", "max_rows")


def rule_condition(match: dict) -> Column:
    """A policy rule over the columns tier, sensitivity, contributor and rows; an unknown condition never matches."""
    out = F.lit(True)
    for key, expected in match.items():
        if key not in KNOWN_CONDITIONS:
            return F.lit(False)
        if key == "min_rows":
            out = out & F.coalesce(F.col("rows") >= expected, F.lit(False))
        elif key == "max_rows":
            out = out & F.coalesce(F.col("rows") <= expected, F.lit(False))
        else:
            out = out & F.coalesce(F.col(key) == expected, F.lit(False))
    return out


def licensed(source: Column, license_: Column, use: Column, denied: list[str], allowed: list[str], commercial: bool, restricted: bool, unknown: bool) -> Column:
    """Whether a source may be imported: denied ones never; all others where nothing is sold; then by licence and terms."""
    if not commercial:
        return ~source.isin(*denied)
    terms = F.when(use == "allowed", True).when(use == "restricted", F.lit(restricted)).when(use == "unknown", F.lit(unknown)).otherwise(False)
    return F.when(source.isin(*denied), False).when(license_.isin(*allowed), True).otherwise(terms)
