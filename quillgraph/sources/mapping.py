"""Mapping of columns to an ontology's labels, as frames: picks by hints, endpoint expressions, documents, prefixes, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A mapping document as JSON text.
DOCUMENT = "entities array<struct<label:string,column:string,confidence:string>>, relationships array<struct<`from`:string,`to`:string>>"
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")


def first_free(hint: str, exact: bool) -> Column:
    """The first free column that is the hint, or has it in its name."""
    fits = (lambda c: F.lower(c) == hint) if exact else (lambda c: F.contains(F.lower(c), F.lit(hint)))
    return F.get(F.filter("free", fits), F.lit(0))


def heuristic(columns: DataFrame, hints: dict[str, dict[str, list[str]]]) -> DataFrame:
    """source, label, column, match_on, confidence: for each label the column of a source that a hint names.

    columns: source, place, column; a group holds no more rows than a source has columns. hints: label -> identifying
    field -> column names. Labels choose in their order, exact names before hints found within names, longer hints
    first, then by place. A column serves one label; a label that finds none is left out. Case does not count.
    """
    listed = columns.filter("column IS NOT NULL").groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "column"))), lambda s: s["column"]).alias("free"))
    kind = "struct<label:string,column:string,match_on:string,confidence:string>"
    found = listed.withColumn("picks", F.array().cast(f"array<{kind}>"))
    for label, fields in hints.items():
        ordered = sorted(((h.lower(), f) for f, hs in fields.items() for h in hs), key=lambda x: (-len(x[0]), x))
        tries = []
        for confidence in ("EXTRACTED", "INFERRED"):
            for hint, field in ordered:
                first = first_free(hint, confidence == "EXTRACTED")
                tries.append(F.when(first.isNotNull(), F.struct(F.lit(label).alias("label"), first.alias("column"), F.lit(field).alias("match_on"), F.lit(confidence).alias("confidence"))))
        found = found.withColumn("pick", F.coalesce(*tries) if tries else F.lit(None).cast(kind))
        taken = F.when(F.col("pick").isNotNull(), F.filter("free", lambda c: c != F.col("pick.column"))).otherwise(F.col("free"))
        found = found.withColumns({"free": taken, "picks": F.when(F.col("pick").isNotNull(), F.array_append("picks", F.col("pick"))).otherwise(F.col("picks"))})
    return found.select("source", F.inline("picks"))


def endpoint(expression: Column) -> Column:
    """(label, field, column) of an expression like Taxon(taxon_id=row.tax_id); null for anything else."""
    pattern = r"^\s*(\w+)\s*\(\s*(\w+)\s*=\s*row\.([\w .-]+?)\s*\)\s*\z"
    part = lambda i: F.regexp_extract(expression, pattern, i)
    return F.when(expression.rlike(pattern), F.struct(part(1).alias("label"), part(2).alias("field"), part(3).alias("column")))


def problems(documents: DataFrame) -> DataFrame:
    """id, problem: what is wrong with each mapping document (columns id, mapping as JSON text); sound ones give no row."""
    told = documents.select("id", F.from_json("mapping", DOCUMENT).alias("d")).select("id", "d.*")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    at = lambda kind, i, text: F.concat(F.lit(f"{kind}/"), i.cast("string"), F.lit(": "), text)
    unknown = lambda c: c.isNotNull() & ~c.isin(*CONFIDENCES)
    required = lambda k: F.transform("entities", lambda e, i: F.when(empty(e[k]), at("entities", i, F.lit(f"{k} is required"))))
    doubt = F.transform("entities", lambda e, i: F.when(unknown(e["confidence"]), at("entities", i, F.concat(F.lit("unknown confidence "), e["confidence"]))))
    wrong = lambda x, i: F.when(endpoint(F.coalesce(x, F.lit(""))).isNull(), at("relationships", i, F.concat(F.lit("not an endpoint: "), F.coalesce(x, F.lit("")))))
    ends = lambda k: F.transform("relationships", lambda r, i: wrong(r[k], i))
    checks = [required("label"), required("column"), doubt, ends("from"), ends("to")]
    checks.append(F.array(F.when(F.col("entities").isNull(), "entities: must be a list")))
    none = F.array().cast("array<string>")
    return told.select("id", F.explode(F.array_compact(F.concat(*(F.coalesce(c, none) for c in checks)))).alias("problem"))


def unknown_prefixes(ids: DataFrame, registry: DataFrame, least: float = 0.7) -> DataFrame:
    """prefix, n, closest: prefixes of ids (column id, the part before the first colon, in lower case) that the registry
    (column prefix) lacks, how many ids have them, and the most alike registered one by the indel ratio; ties go by name.

    Prefixes are counted before they are compared, so ids never meet the registry.
    """
    from quillgraph.operators.fuzzy import fuzzy

    known = registry.select(F.lower("prefix").alias("prefix")).distinct()
    seen = ids.filter(F.col("id").contains(":")).groupBy(F.lower(F.substring_index("id", ":", 1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    unknown = seen.join(known, "prefix", "left_anti")
    near = fuzzy(unknown.select(F.col("prefix").alias("term")), known.select(F.col("prefix").alias("name"), F.col("prefix").alias("id")), least)
    closest = near.groupBy("term").agg(F.min("name").alias("closest"))
    return unknown.join(closest, F.col("prefix") == F.col("term"), "left").select("prefix", "n", "closest")


def scores(predicted: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """by, precision_, recall, f1 of predicted rows against gold ones, both as sets over all their columns.

    Nothing predicted is fully precise, nothing to find fully recalled. The frames have the same columns.
    """
    rows = predicted.withColumns({"p": F.lit(1), "g": F.lit(0)}).unionByName(gold.withColumns({"p": F.lit(0), "g": F.lit(1)}))
    each = rows.groupBy(*predicted.columns).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    counted = each.groupBy(by).agg(F.sum(F.col("p") * F.col("g")).alias("hits"), F.sum("p").alias("p"), F.sum("g").alias("g"))
    share = lambda n: F.when(F.col(n) == 0, 1.0).otherwise(F.col("hits") / F.col(n))
    both = counted.select(by, share("p").alias("precision_"), share("g").alias("recall"))
    total = F.col("precision_") + F.col("recall")
    return both.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision_") * F.col("recall") / total))
