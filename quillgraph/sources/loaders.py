"""Loader transforms: raw records of each source as DataFrames to rows of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import direction_of, disease_id, first_filled, normal_disease

#: Fixed values of the literature source: semantic types, predicates and what they say about direction.
MICROBES, DISEASES = ("bact", "fngs", "virs", "arch"), ("dsyn", "neop", "mobd", "patf", "sosy")
PREDICATES = ("CAUSES", "TREATS", "PREVENTS", "PREDISPOSES", "ASSOCIATED_WITH", "AFFECTS", "INHIBITS", "STIMULATES", "PRODUCES", "INTERACTS_WITH", "DISRUPTS", "AUGMENTS", "COMPLICATES", "COEXISTS_WITH")
RAISING, LOWERING = ("CAUSES", "PREDISPOSES", "COMPLICATES"), ("TREATS", "PREVENTS", "INHIBITS")
#: Suffixes of modified residues.
MODIFICATIONS = {
    "-p": "phosphorylation",
    "-ac": "acetylation",
    "-ub": "ubiquitination",
    "-m1": "methylation",
    "-m2": "methylation",
    "-m3": "methylation",
    "-ga": "glycosylation",
    "-gl": "glycosylation",
    "-sc": "glycosylation",
    "-sm": "sumoylation",
    "-ne": "neddylation",
    "-pa": "palmitoylation",
    "-cr": "crotonylation",
}


def disbiome(rows: DataFrame) -> DataFrame:
    """Associations from records with microorganism, ncbi_taxid, disease, doid, qualitative_outcome, pmid."""
    taxid = F.trim(F.col("ncbi_taxid").cast("string"))
    taxon = F.when(taxid != "", F.concat(F.lit("NCBITaxon:"), taxid)).otherwise(F.concat(F.lit("disbiome:"), F.col("microorganism")))
    none = F.lit("")
    named = rows.filter("microorganism != '' AND disease != ''")
    return named.select(
        taxon.alias("taxon_id"),
        F.col("microorganism").alias("taxon_name"),
        disease_id(F.regexp_replace(F.coalesce("doid", none), "^DOID:", ""), none, none, none, none, F.col("disease")).alias("disease_id"),
        normal_disease(F.col("disease")).alias("name_normalized"),
        direction_of(F.col("qualitative_outcome")).alias("direction"),
        F.col("pmid").cast("string").alias("pmid"),
    )


def signature_direction(raw: Column) -> Column:
    """increased/enriched and decreased/depleted; UP and DOWN count as altered, as the source's map is only asked in lower case."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin("increased", "enriched"), "enriched").when(low.isin("decreased", "depleted"), "depleted").otherwise("altered")


def signature_taxa(rows: DataFrame, names: str, ids: str) -> DataFrame:
    """One row a taxon of semicolon lists: names and ids go pairwise, missing ids are empty, lineages give their last part."""
    parts = lambda c, keep: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: (x != "") if keep else F.lit(True))
    listed = rows.withColumn("__names", parts(F.col(names), True)).withColumn("__ids", parts(F.col(ids), False))
    each = listed.select(*rows.columns, F.posexplode("__names").alias("__i", "__name"), "__ids")
    last = F.trim(F.element_at(F.split("__name", r"\|"), -1))
    plain = F.when(last.contains("__"), F.replace(F.regexp_replace(last, r"^.*?__", ""), F.lit("_"), F.lit(" "))).otherwise(last)
    name = F.substring(F.when(F.col("__name").contains("|"), plain).otherwise(F.col("__name")), 1, 500)
    return each.select(*rows.columns, name.alias("name"), F.coalesce(F.get("__ids", F.col("__i")), F.lit("")).alias("id"))


def predications(rows: DataFrame) -> DataFrame:
    """Microbe-disease predications with a relevant predicate, and its direction."""
    wanted = F.col("subject_type").isin(*MICROBES) & F.col("object_type").isin(*DISEASES) & F.col("predicate").isin(*PREDICATES)
    direction = F.when(F.col("predicate").isin(*RAISING), "enriched").when(F.col("predicate").isin(*LOWERING), "depleted").otherwise("altered")
    return rows.filter(wanted).withColumn("direction", direction)


def residues(rows: DataFrame, column: str) -> DataFrame:
    """site and ptm of modified residues, a site and after its last hyphen a known mark; other rows go."""
    value = F.trim(F.col(column))
    mark = F.concat(F.lit("-"), F.substring_index(value, "-", -1))
    names = F.create_map(*(F.lit(x) for kv in MODIFICATIONS.items() for x in kv))
    site = value.substr(F.lit(1), F.length(value) - F.length(mark))
    return rows.withColumn("site", site).withColumn("ptm", F.element_at(names, mark)).filter("site != '' AND ptm IS NOT NULL")


#: The scientific names of the groups that a microbiome load keeps.
GROUPS = ["Bacteria", "Archaea", "Fungi", "Viruses"]


def taxa(nodes: DataFrame, names: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """tax_id, parent_id, rank, name and the names at each rank above, of the taxa below the groups (by scientific
    name; default GROUPS), from taxonomy nodes and names. A group that names no taxon has none."""
    from quillgraph.functions.lineage import scratch
    from quillgraph.operators import intervals

    scientific = names.filter("name_class = 'scientific name'").groupBy("tax_id").agg(F.min("name").alias("name"))
    labels = intervals.labelled(nodes.select(F.col("tax_id").alias("id"), F.col("parent_id").alias("parent")))
    known = nodes.groupBy(F.col("tax_id").cast("string").alias("id")).agg(F.first("tax_id").alias("tax_id"), F.min("parent_id").alias("parent_id"), F.min("rank").alias("rank"))
    table = intervals.write_sorted(labels.drop("parent").join(known, "id").join(scientific, "tax_id", "left"), scratch(nodes.sparkSession))
    roots = [r["id"] for r in table.filter(F.col("name").isin(groups or GROUPS)).select("id").collect()]  # a few taxa have these names
    columns = intervals.rank_columns(table)
    return intervals.below(table, roots).join(columns, "id").select("tax_id", "parent_id", "rank", "name", *intervals.RANKS)


def abundances(rows: DataFrame) -> DataFrame:
    """Mean and deviation of abundances by taxon and phenotype; what is no number is null."""
    value = F.col("abundance").try_cast("double")
    return rows.groupBy("taxon_id", "phenotype").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))


def compound_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("compound_id", first_filled(F.col("inchi_key"), F.concat(F.lit("CID:"), F.col("pubchem_cid").cast("string"))))


def assays(rows: DataFrame, first: int = 20) -> DataFrame:
    """Of each compound's first rows, those that are active."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("compound_id").orderBy("row"))
    return rows.withColumn("__k", place).filter((F.col("__k") <= first) & (F.col("activity") == "Active")).drop("__k")


def keyword_pathways(rows: DataFrame, words: list[str]) -> DataFrame:
    """Pathways whose name has one of the words, in any case."""
    return rows.filter(F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.lower("name").contains(w)))
