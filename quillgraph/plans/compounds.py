"""Compound, drug and protein sources over the driver's tables: whole tables in the shape of each source's records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.lineage import scratch
from quillgraph.plans.registry import query
from quillgraph.plans.views import Graph
from quillgraph.sources import compounds, readers


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'gutmdisorder:' || lower(s_name) ELSE 'NCBITaxon:' || s_suppkey END AS taxon_id, lower(n_name) AS name_normalized, CASE s_suppkey % 3 WHEN 0 THEN 'enriched' WHEN 1 THEN 'depleted' ELSE 'altered' END AS direction FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0")
def i4_gut_disorders(g: Graph) -> DataFrame:
    """A tab-delimited export, written and read back under its headers; rows without a disorder go."""
    id_ = F.col("s_suppkey")
    change = F.when(id_ % 3 == 0, "Increased").when(id_ % 3 == 1, "REDUCED").otherwise("changed")
    disorder = F.when(id_ % 7 != 0, F.col("n_name"))
    rows = g.table("supplier").join(F.broadcast(g.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    at = scratch(g.spark)
    rows.select(F.col("s_name").alias("GutMicrobe"), disorder.alias("Condition1"), F.when(id_ % 3 != 0, id_.cast("string")).alias("NCBI_Taxonomy_ID"), change.alias("Alteration")).write.option("sep", "\t").option("header", True).csv(at)
    return compounds.gut_disorders(readers.delimited(g.spark, at, "\t")).select("taxon_id", "name_normalized", "direction")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 END AS carbon_chain_length, p_size % 4 < 2 AS is_scfa, p_size % 4 IN (0, 2) OR p_brand = 'Brand#7' AS is_microbial FROM part WHERE p_size % 4 < 3 OR p_brand = 'Brand#7'""")
def i6_metabolites(g: Graph) -> DataFrame:
    """Exact names only make a short-chain fatty acid: a conjugate that lists one as a synonym is microbial but none."""
    kind = F.col("p_size") % 4
    name = F.when(kind == 0, " Acetic acid").when(kind == 1, "part").otherwise("acetylpart")
    rows = g.table("part").select("p_partkey", F.col("p_partkey").cast("string").alias("hmdb_id"), name.alias("name"), F.when(kind == 1, "Butanoic Acid").alias("iupac_name"), F.when(kind == 2, F.array(F.lit("x"), F.lit("Acetic acid"))).alias("synonyms"), F.col("p_brand").alias("class"))
    return compounds.metabolites(rows, {"acetic acid": 2, "butanoic acid": 4}, ["Acetic acid"], ["Brand#7"], microbial_only=True).select("p_partkey", "carbon_chain_length", "is_scfa", "is_microbial")


@query("""WITH l AS (SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 THEN 'PUBCHEM:' ELSE 'INCHIKEY:' END || l_partkey AS src, l_shipmode, l_partkey FROM lineitem WHERE l_partkey % 5 <> 0)
          SELECT 'FOUND_IN' AS type, src, 'HMDB_SITE:' || replace(lower(l_shipmode), ' ', '_') AS dst, NULL AS evidence FROM l
          UNION ALL SELECT DISTINCT 'BIOMARKER_FOR', src, lower(p_brand), p_type FROM l JOIN part ON p_partkey = l_partkey
          UNION ALL SELECT DISTINCT 'PARTICIPATES_IN', src, CASE p_size % 3 WHEN 0 THEN 'KEGG:' || p_size WHEN 1 THEN 'SMPDB:' || p_size ELSE 'HMDB_PATH:' || replace(lower(p_name), ' ', '_') END, NULL FROM l JOIN part ON p_partkey = l_partkey""".replace("l_shipmode", "l_returnflag"))
def i7_metabolome(g: Graph) -> DataFrame:
    """Compounds with a place in the body; those without an identifier go, with all their edges."""
    id_, size = F.col("p_partkey"), F.col("p_size")
    text = id_.cast("string")
    places = g.table("lineitem").groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("biofluids"))  # three values
    rows = g.table("part").join(places, id_ == F.col("l_partkey"), "left").select(
        text.alias("hmdb_id"),
        F.col("p_name").alias("name"),
        F.when((id_ % 3 != 0) & (id_ % 5 != 0), text).alias("inchi_key"),
        F.when((id_ % 3 == 0) & (id_ % 5 != 0), text).alias("pubchem_cid"),
        F.lit(False).alias("is_endogenous"),
        "biofluids",
        F.lit(None).cast("array<string>").alias("tissues"),
        F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("evidence"))).alias("diseases"),
        F.array(F.struct(F.when(size % 3 == 0, size.cast("string")).alias("kegg_id"), F.when(size % 3 == 1, size.cast("string")).alias("smpdb_id"), F.col("p_name").alias("name"))).alias("pathways"),
    )
    _, found, markers, takes_part = compounds.metabolome(rows)
    none = F.lit(None).cast("string")
    parts = [found.withColumn("evidence", none), markers.withColumnRenamed("evidence_level", "evidence"), takes_part.withColumn("evidence", none)]
    tagged = [p.select(F.lit(t).alias("type"), "src", "dst", "evidence") for p, t in zip(parts, ("FOUND_IN", "BIOMARKER_FOR", "PARTICIPATES_IN"), strict=True)]
    return tagged[0].unionAll(tagged[1]).unionAll(tagged[2])


@query("""SELECT 'KEGG:map' || n_nationkey AS pathway_id, n_name AS name, r_name AS category, CASE WHEN n_nationkey % 2 = 0 THEN 'metabolic' ELSE 'other' END AS pathway_type, n_nationkey % 10 = 3 AS microbial_pathway, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS compounds
          FROM nation JOIN region ON n_regionkey = r_regionkey""".replace("r_name AS category", "CASE WHEN n_nationkey % 2 = 0 THEN 'Metabolism of ' || r_name ELSE r_name END AS category"))
def i8_flat_pathways(g: Graph) -> DataFrame:
    """Flat records with continued lines, written as text and read back."""
    listed = g.table("supplier").groupBy("s_nationkey").agg(F.concat_ws("\n            ", F.array_sort(F.collect_list(F.concat(F.lit("C"), F.col("s_suppkey").cast("string"), F.lit("  name"))))).alias("compounds"))
    rows = g.place.join(listed, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    category = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "Metabolism of ").otherwise(""), "r_name")
    text = F.concat(F.lit("ENTRY       map"), F.col("n_nationkey").cast("string"), F.lit("   Pathway\nNAME        "), "n_name", F.lit("\nCLASS       "), category, F.lit("; sub\nCOMPOUND    "), F.coalesce("compounds", F.lit("none")), F.lit("\n///"))
    at = scratch(g.spark)
    rows.select(text.alias("value")).write.text(at)
    pathways, edges = compounds.kegg_pathways(readers.flat_records(g.spark, at), ["3"])
    sizes = edges.groupBy(F.col("dst").alias("pathway_id")).agg(F.count(F.lit(1)).alias("compounds"))
    return pathways.join(sizes, "pathway_id", "left").select("pathway_id", "name", "category", "pathway_type", "microbial_pathway", F.coalesce("compounds", F.lit(0)).alias("compounds"))


@query("""SELECT 'CHEMBL:' || l_partkey AS src, 'CHEMBL:' || l_suppkey AS dst, min(l_returnflag) AS action_type FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size % 5 = 4 AND s_suppkey % 2 = 0 GROUP BY 1, 2
          UNION ALL SELECT 'CHEMBL:' || p_partkey, NULL, p_type FROM part WHERE p_size % 5 = 4""")
def i10_drug_targets(g: Graph) -> DataFrame:
    """Edges of approved drugs to known targets, and all approved drugs, with a mechanism or without one."""
    text = lambda c: F.col(c).cast("string")
    molecules = g.table("part").select(text("p_partkey").alias("molecule_chembl_id"), F.col("p_name").alias("pref_name"), F.col("p_type").alias("molecule_type"), (F.col("p_size") % 5).cast("string").alias("max_phase"))
    mechanisms = g.table("lineitem").select(text("l_partkey").alias("molecule_chembl_id"), text("l_suppkey").alias("target_chembl_id"), F.col("l_returnflag").alias("action_type"), F.lit("m").alias("mechanism_of_action"))
    targets = g.table("supplier").filter("s_suppkey % 2 = 0").select(text("s_suppkey").alias("target_chembl_id"), F.col("s_name").alias("pref_name"), F.lit("SINGLE PROTEIN").alias("target_type"), F.lit("h").alias("organism"), F.array(F.struct(F.col("s_name").alias("accession"))).alias("target_components"))
    drugs, _, edges = compounds.drug_targets(molecules, mechanisms, targets)
    return edges.select("src", "dst", "action_type").unionAll(drugs.select("drug_id", F.lit(None).cast("string"), "drug_type"))


@query("""SELECT 'INCHIKEY:K' || p_partkey AS src, 'METACYC:' || p_brand AS dst FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'INCHIKEY:K' || p_partkey, 'METACYC:' || p_size FROM part WHERE p_partkey % 3 = 0
          UNION ALL SELECT 'PUBCHEM:' || p_partkey, 'METACYC:' || p_brand FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT 'PUBCHEM:' || p_partkey, 'METACYC:' || p_size FROM part WHERE p_partkey % 3 = 1""")
def i16_attribute_records(g: Graph) -> DataFrame:
    """Attribute records, written as text and read back; compounds without an identifier go."""
    id_ = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 3
    own = F.when(kind == 0, F.concat(F.lit("\nINCHI-KEY - InChIKey=K"), id_)).when(kind == 1, F.concat(F.lit("\nPUBCHEM-ID - "), id_)).otherwise("")
    text = F.concat(F.lit("UNIQUE-ID - CPD-"), id_, F.lit("\nCOMMON-NAME - "), "p_name", own, F.lit("\nIN-PATHWAY - "), "p_brand", F.lit("\nIN-PATHWAY - "), F.col("p_size").cast("string"), F.lit("\n//"))
    at = scratch(g.spark)
    rows = g.table("part")
    rows.select(text.alias("value")).write.text(at)
    records = readers.flat_records(g.spark, at, "//")
    return compounds.metacyc(records, records)[2]


@query("""WITH c AS (SELECT p_partkey AS id, lower(p_name) AS name, 0 AS tier, p_size > 10 AS observed FROM part UNION ALL SELECT p_partkey, lower(p_brand), 1, p_size > 10 FROM part WHERE p_size < 12 UNION ALL SELECT p_partkey, lower(p_type), 2, p_size > 10 FROM part),
               w AS (SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT DISTINCT lower(p_brand) FROM part UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT 'p' || p_partkey FROM part),
               a AS (SELECT * FROM c UNION ALL SELECT p_partkey, 'p' || p_partkey, 2, p_size > 10 FROM part),
               r AS (SELECT name, id, min(tier) + CASE WHEN observed THEN 0 ELSE 10 END AS rank FROM a GROUP BY name, id, observed),
               b AS (SELECT r.name, min(id) AS id, count(DISTINCT id) AS n FROM r JOIN (SELECT name, min(rank) AS best FROM r GROUP BY 1) x ON x.name = r.name AND r.rank = best WHERE r.name <> 'brand#7' GROUP BY 1)
          SELECT w.name, CASE WHEN w.name = 'brand#7' THEN (SELECT 'C' || p_partkey FROM part WHERE p_brand = 'Brand#7' AND p_size < 12 ORDER BY p_partkey LIMIT 1) WHEN n = 1 THEN 'C' || id END AS compound_id FROM w LEFT JOIN b ON b.name = w.name""")
def i18_curated_compounds(g: Graph) -> DataFrame:
    """Pin, then observed evidence, then own name, systematic name and synonym; what several claim is refused."""
    part, id_ = g.table("part"), F.col("p_partkey").cast("string")
    mark = F.concat(F.lit("P"), id_)
    known = part.select(F.concat(F.lit("C"), id_).alias("compound_id"), id_.alias("hmdb_id"), F.when(F.col("p_size") > 10, " Detected").otherwise("predicted").alias("hmdb_status"), F.col("p_name").alias("name"), F.when(F.col("p_size") < 12, F.col("p_brand")).alias("iupac_name"), F.array("p_type", mark).alias("synonyms"))
    names = part.select(F.explode(F.array("p_name", "p_brand", "p_type", mark)).alias("name"))
    pin = part.filter("p_brand = 'Brand#7' AND p_size < 12").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").cast("string").alias("hmdb_id"))
    return compounds.curated_compounds(names, known, pin)
