"""Records of signature, predication, abundance, body-site, residue and literature sources as rows of nodes and edges.

Columns that a file lacks count as empty; texts are trimmed, and what is empty is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import disease_id, first_filled, normal_disease
from quillgraph.sources import loaders


def given(rows: DataFrame, *names: str) -> Column:
    """The first of the named columns that is there and filled."""
    there = [F.trim(F.col(f"`{n}`").cast("string")) for n in names if n in rows.columns]
    return first_filled(*there) if there else F.lit(None).cast("string")


def taxon_key(ncbi: Column, prefix: str, name: Column) -> Column:
    """The taxonomy's identifier where there is one, else one made of the name."""
    own = F.concat(F.lit(f"{prefix}:"), F.lower(F.replace(name, F.lit(" "), F.lit("_"))))
    return F.coalesce(F.concat(F.lit("NCBITaxon:"), F.when(ncbi != "", ncbi)), own)


def disease_columns(name: Column, umls: Column | None = None) -> list[Column]:
    none = F.lit("")
    key = disease_id(none, none, none, F.coalesce(umls, none) if umls is not None else none, none, name)
    return [key.alias("disease_id"), name.alias("disease_name"), normal_disease(name).alias("name_normalized")]


def signatures(rows: DataFrame) -> DataFrame:
    """A row a taxon of each signature; signatures without a condition or taxa go."""
    told = rows.select(
        given(rows, "Condition").alias("condition"),
        given(rows, "Microbe Names", "MetaPhlAn taxon names").alias("names"),
        given(rows, "NCBI Taxonomy IDs").alias("ids"),
        F.coalesce(loaders.signature_direction(given(rows, "Direction", "Abundance in Group 1")), F.lit("altered")).alias("direction"),
        given(rows, "PMID").alias("pmid"),
        given(rows, "Body Site").alias("body_site"),
    )
    each = loaders.signature_taxa(told.filter("condition IS NOT NULL AND names IS NOT NULL"), "names", "ids")
    key = taxon_key(F.col("id"), "bugsigdb", F.col("name")).alias("taxon_id")
    return each.select(key, F.col("name").alias("taxon_name"), *disease_columns(F.col("condition")), "direction", "pmid", "body_site")


def predication_edges(rows: DataFrame) -> DataFrame:
    """Microbe to disease by predicate; types and predicates in any case, nameless ends go."""
    told = rows.select(
        F.lower(given(rows, "SUBJECT_SEMTYPE")).alias("subject_type"),
        F.lower(given(rows, "OBJECT_SEMTYPE")).alias("object_type"),
        F.upper(given(rows, "PREDICATE")).alias("predicate"),
        *(given(rows, n).alias(n.lower()) for n in ("SUBJECT_NAME", "OBJECT_NAME", "SUBJECT_CUI", "OBJECT_CUI", "PMID", "SENTENCE")),
    )
    kept = loaders.predications(told.filter("subject_name IS NOT NULL AND object_name IS NOT NULL"))
    made = F.concat(F.lit("semmeddb:"), F.lower(F.replace("subject_name", F.lit(" "), F.lit("_"))))
    key = F.coalesce(F.concat(F.lit("UMLS:"), "subject_cui"), made).alias("taxon_id")
    return kept.select(key, F.col("subject_name").alias("taxon_name"), *disease_columns(F.col("object_name"), F.col("object_cui")), "predicate", "direction", "pmid", "sentence")


def phenotype_abundances(rows: DataFrame) -> DataFrame:
    """Taxon to phenotype with mean, deviation and samples; what is no number is null."""
    name, ncbi, phenotype = given(rows, "scientific_name", "organism_name"), given(rows, "ncbi_taxon_id"), given(rows, "phenotype")
    number = lambda kind, *names: given(rows, *names).try_cast(kind)
    told = rows.filter(phenotype.isNotNull() & (name.isNotNull() | ncbi.isNotNull()))
    return told.select(
        taxon_key(ncbi, "gmrepo", name).alias("taxon_id"),
        F.coalesce(name, F.concat(F.lit("taxon_"), ncbi)).alias("taxon_name"),
        F.coalesce(given(rows, "taxon_rank_level"), F.lit("species")).alias("rank"),
        *disease_columns(phenotype),
        F.coalesce(loaders.signature_direction(given(rows, "direction")), F.lit("altered")).alias("direction"),
        number("double", "abus_mean", "abundance_mean").alias("abundance_mean"),
        number("double", "abus_sd", "abundance_std").alias("abundance_std"),
        number("long", "samples", "samples_count").alias("samples"),
    )


def body_sites(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sites, FOUND_IN) of taxa; a taxon is known by its number or its name."""
    name, ncbi, site = given(rows, "taxon_name"), given(rows, "ncbi_tax_id"), given(rows, "body_site")
    told = rows.filter(site.isNotNull() & (name.isNotNull() | ncbi.isNotNull()))
    number = lambda c: given(rows, c).try_cast("double").alias(c)
    found = told.select(
        taxon_key(ncbi, "mbodymap", name).alias("src"), F.concat(F.lit("bodysite:"), F.lower(site)).alias("dst"), F.coalesce(name, ncbi).alias("taxon_name"), number("relative_abundance"), number("prevalence"), given(rows, "health_status").alias("health_status")
    )
    sites = told.select(F.concat(F.lit("bodysite:"), F.lower(site)).alias("site_id"), F.lower(site).alias("name")).distinct()
    return sites, found


def modified_sites(rows: DataFrame, organism: str = "human") -> tuple[DataFrame, DataFrame]:
    """(modifications, HAS_MODIFICATION) of the proteins of an organism; residues without a known mark go."""
    mine = rows.filter(F.lower(given(rows, "ORGANISM")) == organism).filter(given(rows, "ACC_ID").isNotNull())
    marked = loaders.residues(mine, "MOD_RSD")
    key = F.concat_ws(":", given(rows, "ACC_ID"), "ptm", "site")
    count = F.coalesce(given(rows, "LT_LIT").try_cast("int"), F.lit(0))
    told = marked.select(key.alias("modification_id"), given(rows, "ACC_ID").alias("accession"), "ptm", "site", given(rows, "GENE").alias("gene"), given(rows, "KINASE").alias("enzyme"), count.alias("evidence_count"))
    best = told.groupBy("modification_id").agg(F.max(F.struct("evidence_count", "accession", "ptm", "site", "gene", "enzyme")).alias("m")).select("modification_id", "m.*")
    return best, best.select(F.col("accession").alias("src"), F.col("modification_id").alias("dst"))


def articles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers, MENTIONED_IN) of articles with pmid, title, abstract and headings (an array); headings become diseases."""
    papers = rows.filter("pmid IS NOT NULL").select(F.concat(F.lit("PMID:"), F.col("pmid").cast("string")).alias("paper_id"), "title", "abstract", "headings")
    each = papers.select("paper_id", F.explode("headings").alias("heading")).filter(F.trim("heading") != "")
    diseases = each.select(disease_columns(F.col("heading"))[0].alias("src"), F.col("paper_id").alias("dst")).distinct()
    return papers.groupBy("paper_id").agg(F.min("title").alias("title"), F.min("abstract").alias("abstract")), diseases


def measurements(studies: DataFrame) -> DataFrame:
    """study, sample, compound, value of nested studies: id, samples (array of id and measurements of compound and value)."""
    samples = studies.select(F.col("id").alias("study"), F.explode("samples").alias("s"))
    return samples.select("study", F.col("s.id").alias("sample"), F.inline("s.measurements")).filter("compound IS NOT NULL").select("study", "sample", "compound", F.col("value").try_cast("double").alias("value"))
