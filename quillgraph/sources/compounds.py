"""Compound, pathway, protein and drug sources: raw records as DataFrames to rows of nodes and edges.

Every edge frame has src and dst and one row a pair; where several records name a pair, the least record decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import direction_of, disease_id, first_filled, normal_disease
from quillgraph.sources.readers import field

#: Evidence states of compounds that were observed, not predicted.
OBSERVED = ("quantified", "detected")


def clean(value: Column) -> Column:
    return F.lower(F.trim(value))


def slug(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit(" "), F.lit("_"))


def compound_id(inchi_key: Column, pubchem_cid: Column) -> Column:
    """The structure key before the registry number; null if both are missing."""
    cid = F.nullif(pubchem_cid.cast("string"), F.lit(""))
    return F.coalesce(F.concat(F.lit("INCHIKEY:"), F.nullif(inchi_key, F.lit(""))), F.concat(F.lit("PUBCHEM:"), cid))


def values(record: Column, key: str) -> Column:
    """All values of a key in a record of (key, value) pairs."""
    return F.transform(F.filter(record, lambda f: f["key"] == key), lambda f: f["value"])


def gut_disorders(rows: DataFrame) -> DataFrame:
    """Associations of microbes with disorders, under either spelling of the headers; rows without both names go."""

    def either(*headers: str) -> Column:
        found = [F.trim(F.col(f"`{h}`")) for h in headers if h in rows.columns]
        return F.coalesce(first_filled(*found), F.lit("")) if found else F.lit("")

    none = F.lit("")
    named = rows.select(
        either("Gut Microbe", "GutMicrobe").alias("taxon_name"),
        either("Disorder", "Condition1").alias("disease_name"),
        either("NCBI ID", "NCBI_Taxonomy_ID").alias("taxid"),
        either("Alteration").alias("alteration"),
        either("Evidence Type").alias("evidence_type"),
        either("Sample Type").alias("sample_type"),
        either("PMID").alias("pmid"),
    ).filter("taxon_name != '' AND disease_name != ''")
    taxon = F.when(F.col("taxid") != "", F.concat(F.lit("NCBITaxon:"), "taxid")).otherwise(F.concat(F.lit("gutmdisorder:"), F.lower("taxon_name")))
    disease = F.col("disease_name")
    return named.select(
        taxon.alias("taxon_id"),
        "taxon_name",
        disease_id(none, none, none, none, none, disease).alias("disease_id"),
        normal_disease(disease).alias("name_normalized"),
        direction_of(F.col("alteration")).alias("direction"),
        "evidence_type",
        "sample_type",
        "pmid",
    )


def metabolites(rows: DataFrame, chains: dict[str, int], curated: list[str], classes: list[str], microbial_only: bool = False) -> DataFrame:
    """rows (hmdb_id, name, iupac_name, synonyms, class) with carbon_chain_length, is_scfa and is_microbial.

    A short-chain fatty acid has just one of the names in chains as its own or its systematic name; synonyms name the
    acyl part of conjugates too and do not count for that. They do count for is_microbial, beside the chemical class.
    """
    own = F.filter(F.array(clean(F.col("name")), clean(F.col("iupac_name"))), lambda n: n.isNotNull() & (n != ""))
    also = F.coalesce(F.transform("synonyms", clean), F.array().cast("array<string>"))
    lengths = F.create_map(*(F.lit(x) for kv in chains.items() for x in kv))
    length = F.get(F.filter(F.transform(own, lambda n: F.element_at(lengths, n)), lambda x: x.isNotNull()), F.lit(0))
    known = F.arrays_overlap(F.concat(own, F.array_compact(also)), F.array(*(F.lit(c.lower()) for c in curated)))
    microbial = F.coalesce(known, F.lit(False)) | F.coalesce(F.lower("class").isin([c.lower() for c in classes]), F.lit(False))
    named = rows.filter("hmdb_id != '' AND name != ''").withColumns({"carbon_chain_length": length, "is_microbial": microbial})
    flagged = named.withColumn("is_scfa", F.col("carbon_chain_length").isNotNull())
    return flagged.filter("is_microbial OR is_scfa") if microbial_only else flagged


def metabolome(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(compounds, FOUND_IN, BIOMARKER_FOR, PARTICIPATES_IN) of compounds that have a place in the body or are endogenous.

    rows: hmdb_id, name, inchi_key, pubchem_cid, is_endogenous, biofluids and tissues (arrays of names), diseases
    (array of name, evidence) and pathways (array of kegg_id, smpdb_id, name).
    """
    none = F.array().cast("array<string>")
    places = F.array_distinct(F.concat(F.coalesce("biofluids", none), F.coalesce("tissues", none)))
    all_ = rows.filter("hmdb_id != ''").withColumns({"compound_id": compound_id(F.col("inchi_key"), F.col("pubchem_cid")), "places": places})
    kept = all_.filter((F.size("places") > 0) | F.coalesce("is_endogenous", F.lit(False))).filter("compound_id IS NOT NULL")
    compounds = kept.groupBy("compound_id").agg(F.min("hmdb_id").alias("hmdb_id"), F.min_by("name", "hmdb_id").alias("name"))
    src = F.col("compound_id").alias("src")
    found = kept.select(src, F.explode("places").alias("place")).select("src", F.concat(F.lit("HMDB_SITE:"), slug(F.col("place"))).alias("dst")).distinct()
    ill = kept.select(src, "hmdb_id", F.posexplode("diseases").alias("i", "d")).filter("d.name != ''").withColumn("dst", normal_disease(F.col("d.name")))
    markers = ill.groupBy("src", "dst").agg(F.min_by(F.coalesce("d.evidence", F.lit("")), F.struct("hmdb_id", "i")).alias("evidence_level"))
    filled = lambda c: F.nullif(F.col(f"p.{c}"), F.lit(""))
    pathway = F.coalesce(F.concat(F.lit("KEGG:"), filled("kegg_id")), F.concat(F.lit("SMPDB:"), filled("smpdb_id")), F.concat(F.lit("HMDB_PATH:"), slug(filled("name"))))
    takes_part = kept.select(src, F.explode("pathways").alias("p")).select("src", pathway.alias("dst")).filter("dst IS NOT NULL").distinct()
    return compounds, found, markers, takes_part


def kegg_pathways(records: DataFrame, microbial: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pathways, PARTICIPATES_IN by the compounds' accession) of flat records; microbial: endings of pathway numbers."""
    record = F.col("record")
    parts = F.split(field(record, "CLASS"), ";")
    rows = records.select(F.regexp_extract(field(record, "ENTRY"), r"^(\S+)", 1).alias("kegg_id"), field(record, "NAME").alias("name"), F.nullif(F.trim(F.get(parts, F.lit(0))), F.lit("")).alias("category"), F.trim(F.get(parts, F.lit(1))).alias("subcategory"), F.split(field(record, "COMPOUND"), " ; ").alias("compounds"))
    rows = rows.filter("kegg_id != ''").withColumn("pathway_id", F.concat(F.lit("KEGG:"), "kegg_id"))
    kind = F.when(F.lower(F.coalesce("category", F.lit(""))).contains("metabolism"), "metabolic").otherwise("other")
    ends = F.exists(F.array(*(F.lit(m) for m in microbial)).cast("array<string>"), lambda m: F.col("kegg_id").endswith(m))
    pathways = rows.select("pathway_id", "name", "category", "subcategory", kind.alias("pathway_type"), ends.alias("microbial_pathway"))
    edges = rows.select(F.explode("compounds").alias("c"), F.col("pathway_id").alias("dst")).select(F.regexp_extract("c", r"^(C\d+)", 1).alias("src"), "dst").filter("src != ''").distinct()
    return pathways, edges


def drug_targets(molecules: DataFrame, mechanisms: DataFrame, targets: DataFrame, least_phase: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drugs, proteins, TARGETS) of drugs from a phase on, those without a known mechanism too.

    molecules: molecule_chembl_id, pref_name, molecule_type, max_phase; mechanisms: molecule_chembl_id, target_chembl_id,
    action_type, mechanism_of_action; targets: target_chembl_id, pref_name, target_type, organism, target_components
    (array with accession).
    """
    prefixed = lambda c: F.concat(F.lit("CHEMBL:"), c)
    kept = molecules.filter((F.col("max_phase").try_cast("double") >= least_phase) & (F.col("molecule_chembl_id") != ""))
    name = first_filled(F.col("pref_name"), F.col("molecule_chembl_id"))
    drugs = kept.select(prefixed("molecule_chembl_id").alias("drug_id"), name.alias("name"), F.coalesce("molecule_type", F.lit("Unknown")).alias("drug_type"), "max_phase").dropDuplicates(["drug_id"])
    acting = mechanisms.join(kept.select("molecule_chembl_id"), "molecule_chembl_id", "left_semi").filter("target_chembl_id != ''")
    met = acting.join(targets.select("target_chembl_id"), "target_chembl_id", "left_semi")
    edges = met.groupBy(prefixed("molecule_chembl_id").alias("src"), prefixed("target_chembl_id").alias("dst")).agg(F.min(F.struct("action_type", "mechanism_of_action")).alias("m")).select("src", "dst", "m.*")
    accessions = F.filter(F.transform("target_components", lambda c: c["accession"]), lambda a: a.isNotNull() & (a != ""))
    used = targets.join(met.select("target_chembl_id"), "target_chembl_id", "left_semi")
    proteins = used.select(prefixed("target_chembl_id").alias("protein_id"), F.col("pref_name").alias("name"), "target_type", "organism", accessions.alias("uniprot_ids")).dropDuplicates(["protein_id"])
    return drugs, proteins, edges


def metacyc(compounds: DataFrame, pathways: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(compounds, pathways, PARTICIPATES_IN) of attribute records; compounds without an identifier go, with their edges."""
    record = F.col("record")
    named = lambda key: F.concat(F.lit("METACYC:"), F.coalesce(field(record, key), F.lit("")))
    key = F.nullif(F.replace(field(record, "INCHI-KEY"), F.lit("InChIKey="), F.lit("")), F.lit(""))
    rows = compounds.select(compound_id(key, field(record, "PUBCHEM-ID")).alias("compound_id"), named("UNIQUE-ID").alias("metacyc_id"), field(record, "COMMON-NAME").alias("name"), values(record, "IN-PATHWAY").alias("within")).filter("compound_id IS NOT NULL")
    nodes = rows.groupBy("compound_id").agg(F.min("metacyc_id").alias("metacyc_id"), F.min_by("name", "metacyc_id").alias("name"))
    edges = rows.select(F.col("compound_id").alias("src"), F.explode("within").alias("p")).select("src", F.concat(F.lit("METACYC:"), "p").alias("dst")).distinct()
    return nodes, pathways.select(named("UNIQUE-ID").alias("pathway_id"), field(record, "COMMON-NAME").alias("name")).dropDuplicates(["pathway_id"]), edges


def proteins(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proteins, pathway ids by protein, phenotype ids by protein) of tagged protein records; records without an accession go."""
    record = F.col("record")

    def linked(database: str) -> Column:
        fields = F.transform(values(record, "DR"), lambda v: F.transform(F.split(v, ";"), lambda f: F.trim(f)))
        return F.filter(fields, lambda f: (f[0] == database) & (F.coalesce(F.get(f, F.lit(1)), F.lit("")) != ""))

    def after(tag: str, mark: str) -> Column:
        met = F.filter(values(record, tag), lambda v: v.contains(mark))
        return F.trim(F.regexp_extract(F.get(met, F.lit(0)), mark + "([^;]*)", 1))

    accession = F.trim(F.get(F.split(field(record, "AC"), ";"), F.lit(0)))
    phenotypes = F.filter(linked("MIM"), lambda f: F.rtrim(F.coalesce(F.get(f, F.lit(2)), F.lit("")), F.lit(".")) == "phenotype")
    rows = records.select(accession.alias("accession"), after("DE", "Full=").alias("name"), after("GN", "Name=").alias("gene_name"), F.concat_ws(" ", values(record, "OS")).alias("organism"), linked("Reactome").alias("pathways"), phenotypes.alias("phenotypes")).filter("accession != ''")
    ends = lambda c: rows.select(F.col("accession").alias("src"), F.explode(c).alias("f")).select("src", F.get("f", F.lit(1)).alias("dst")).distinct()
    return rows.select("accession", "name", "gene_name", "organism").dropDuplicates(["accession"]), ends("pathways"), ends("phenotypes")


def curated_compounds(names: DataFrame, compounds: DataFrame, pins: DataFrame) -> DataFrame:
    """name, compound_id of each curated name that means just one compound; null where none or several claim it.

    A pinned name (pins: name, hmdb_id) means the candidate with that id or nothing. Otherwise predicted compounds go if
    any candidate was observed; then an own name counts before a systematic one and that before a synonym, and the best
    tier must name a single compound. compounds: compound_id, hmdb_id, hmdb_status, name, iupac_name, synonyms. Three
    equi-joins take the place of a condition with OR.
    """
    wanted = names.select(clean(F.col("name")).alias("name")).distinct()
    known = compounds.filter("compound_id IS NOT NULL").select("compound_id", "hmdb_id", F.coalesce(clean(F.col("hmdb_status")).isin(*OBSERVED), F.lit(False)).alias("observed"), F.lower("name").alias("n0"), F.lower("iupac_name").alias("n1"), F.transform("synonyms", F.lower).alias("more"))
    rest = ["compound_id", "hmdb_id", "observed"]
    claims = known.select(F.col("n0").alias("name"), F.lit(0).alias("tier"), *rest).unionAll(known.select("n1", F.lit(1), *rest)).unionAll(known.select(F.explode("more"), F.lit(2), *rest))
    met = claims.join(wanted, "name").groupBy("name", *rest).agg(F.min("tier").alias("tier"))
    pinned = pins.select(clean(F.col("name")).alias("name"), F.col("hmdb_id").alias("pin")).dropDuplicates(["name"])
    met = met.join(pinned, "name", "left").filter("pin IS NULL OR hmdb_id = pin")
    rank = F.struct(F.when(F.col("pin").isNull() & ~F.col("observed"), 1).otherwise(0).alias("predicted"), F.when(F.col("pin").isNull(), F.col("tier")).otherwise(0).alias("tier"))
    ranked = met.withColumn("rank", rank)
    best = ranked.groupBy("name").agg(F.min("rank").alias("best"))
    top = ranked.join(best, "name").filter("rank = best").groupBy("name").agg(F.min("compound_id").alias("compound_id"), F.countDistinct("compound_id").alias("n"))
    return wanted.join(top, "name", "left").select("name", F.when(F.col("n") == 1, F.col("compound_id")).alias("compound_id"))
