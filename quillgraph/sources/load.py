"""A load: chosen sources from an input folder to bundle folders, one flag a source.

python -m quillgraph.sources.load --in FOLDER --out FOLDER [--all | --metacyc --chembl ...]

Without a flag every source is loaded; a maintenance step runs only if it is named, and naming one loads nothing else.
A source writes its frames under its own name, so that a second run replaces what the first one wrote.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources import compounds, loaders, readers, records

Frames = dict[str, DataFrame]


def taxonomy(spark: SparkSession, at: str) -> Frames:
    nodes, names = readers.taxdump(spark, f"{at}/nodes.dmp", f"{at}/names.dmp")
    return {"Taxon": loaders.taxa(nodes, names)}


def disbiome(spark: SparkSession, at: str) -> Frames:
    return {"ASSOCIATED_WITH_DISEASE": loaders.disbiome(readers.json_records(spark, f"{at}/disbiome.jsonl"))}


def gutmdisorder(spark: SparkSession, at: str) -> Frames:
    return {"ASSOCIATED_WITH_DISEASE": compounds.gut_disorders(readers.delimited(spark, f"{at}/gutmdisorder.tsv", "\t"))}


def kegg(spark: SparkSession, at: str) -> Frames:
    pathways, edges = compounds.kegg_pathways(readers.flat_records(spark, f"{at}/pathways.txt"), [])
    return {"Pathway": pathways, "PARTICIPATES_IN": edges}


def chembl(spark: SparkSession, at: str) -> Frames:
    drugs, proteins, edges = compounds.drug_targets(*(readers.json_records(spark, f"{at}/{n}.jsonl") for n in ("molecule", "mechanism", "target")))
    return {"Drug": drugs, "Protein": proteins, "TARGETS": edges}


def metacyc(spark: SparkSession, at: str) -> Frames:
    nodes, pathways, edges = compounds.metacyc(readers.flat_records(spark, f"{at}/compounds.dat", "//"), readers.flat_records(spark, f"{at}/pathways.dat", "//"))
    return {"Compound": nodes, "Pathway": pathways, "PARTICIPATES_IN": edges}


def uniprot(spark: SparkSession, at: str) -> Frames:
    proteins, pathways, phenotypes = compounds.proteins(readers.flat_records(spark, f"{at}/uniprot.dat", "//"))
    return {"Protein": proteins, "PARTICIPATES_IN": pathways, "LINKED_TO_PHENOTYPE": phenotypes}


def bugsigdb(spark: SparkSession, at: str) -> Frames:
    return {"ASSOCIATED_WITH_DISEASE": records.signatures(readers.delimited(spark, f"{at}/signatures.csv", None, "#"))}


def semmeddb(spark: SparkSession, at: str) -> Frames:
    return {"ASSOCIATED_WITH_DISEASE": records.predication_edges(readers.delimited(spark, f"{at}/predications.csv", ","))}


def gmrepo(spark: SparkSession, at: str) -> Frames:
    return {"ASSOCIATED_WITH_DISEASE": records.phenotype_abundances(readers.json_records(spark, f"{at}/species.jsonl"))}


def mbodymap(spark: SparkSession, at: str) -> Frames:
    sites, found = records.body_sites(readers.delimited(spark, f"{at}/mbodymap.csv"))
    return {"BodySite": sites, "FOUND_IN": found}


def phosphosite(spark: SparkSession, at: str) -> Frames:
    nodes, edges = records.modified_sites(readers.headed(spark, f"{at}/*_site_dataset*", "GENE"))
    return {"Modification": nodes, "HAS_MODIFICATION": edges}


#: Words that make a pathway one of the microbiome's.
PATHWAY_WORDS = [
    "amino acid", "tryptophan", "tyrosine", "phenylalanine", "histidine", "arginine", "proline", "glutamate", "glutamine", "methionine", "cysteine",
    "bile acid", "bile salt", "fatty acid", "short-chain fatty acid", "scfa", "butyrate", "propionate", "acetate", "lipid", "cholesterol",
    "carbohydrate", "glucose", "fructose", "galactose", "pyruvate", "citric acid", "tca cycle", "glycolysis",
    "folate", "vitamin", "biotin", "thiamine", "riboflavin", "cobalamin", "niacin", "pantothenate", "xenobiotic", "drug metabolism",
    "innate immune", "adaptive immune", "toll-like receptor", "tlr", "nod-like receptor", "nlr", "inflammasome",
    "cytokine", "interleukin", "interferon", "nf-kb", "tnf", "antimicrobial peptide", "defensin", "complement", "phagocytosis",
    "t cell", "b cell", "dendritic cell", "macrophage", "neutrophil", "immunoglobulin", "iga",
    "gpcr", "g protein-coupled", "wnt", "notch", "hedgehog", "mapk", "erk", "jnk", "pi3k", "akt", "mtor", "jak-stat", "tgf-beta",
    "serotonin", "dopamine", "gaba", "neurotransmitter", "neuropeptide",
]
#: Short-chain fatty acids with their chain lengths.
CHAINS = {
    "acetate": 2, "acetic acid": 2,
    "propionate": 3, "propionic acid": 3,
    "butyrate": 4, "butyric acid": 4, "butanoate": 4, "butanoic acid": 4,
    "valerate": 5, "valeric acid": 5, "pentanoate": 5, "pentanoic acid": 5,
    "caproate": 6, "hexanoate": 6, "caproic acid": 6, "hexanoic acid": 6,
    "isobutyrate": 4, "isobutyric acid": 4,
    "isovalerate": 5, "isovaleric acid": 5,
}
METABOLITE = "accession string, name string, iupac_name string, synonyms struct<synonym:array<string>>, taxonomy struct<class:string>"


def reactome(spark: SparkSession, at: str) -> Frames:
    named = spark.read.option("sep", "\t").schema("pathway_id string, name string, species string").csv(f"{at}/pathways.txt")
    return {"Pathway": loaders.keyword_pathways(named, PATHWAY_WORDS)}


def pubchem(spark: SparkSession, at: str) -> Frames:
    rows = readers.delimited(spark, f"{at}/assays.csv", ",")
    return {"TESTED_IN": loaders.assays(rows.withColumn("row", F.col("row").try_cast("long")))}


def hmdb(spark: SparkSession, at: str) -> Frames:
    rows = spark.read.format("xml").option("rowTag", "metabolite").schema(METABOLITE).load(f"{at}/metabolites.xml")
    told = rows.select(F.col("accession").alias("hmdb_id"), "name", "iupac_name", F.col("synonyms.synonym").alias("synonyms"), F.col("taxonomy.class").alias("class"))
    return {"Compound": compounds.metabolites(told, CHAINS, list(CHAINS), [])}


def pubmed(spark: SparkSession, at: str) -> Frames:
    rows = spark.read.schema("pmid string, title string, abstract string, headings array<string>").json(f"{at}/articles.jsonl")
    papers, mentioned = records.articles(rows)
    return {"Paper": papers, "MENTIONED_IN": mentioned}


def metabolights(spark: SparkSession, at: str) -> Frames:
    rows = spark.read.schema("id string, samples array<struct<id:string,measurements:array<struct<compound:string,value:string>>>>").json(f"{at}/studies.jsonl")
    return {"MEASURED_IN": records.measurements(rows)}


def opentargets(spark: SparkSession, at: str) -> Frames:
    return {"ASSOCIATED_WITH_TARGET": readers.open_targets(spark, f"{at}/associations")}


SOURCES: dict[str, Callable[[SparkSession, str], Frames]] = {
    f.__name__: f for f in (taxonomy, disbiome, gutmdisorder, kegg, chembl, metacyc, uniprot, bugsigdb, semmeddb, gmrepo, mbodymap, phosphosite, reactome, pubchem, hmdb, pubmed, metabolights, opentargets)
}


def counts(spark: SparkSession, out: str) -> None:
    """Maintenance: how many rows each loaded frame has."""
    for name, frame in sorted(loaded(spark, out).items()):
        print(name, frame.count())


MAINTENANCE: dict[str, Callable[[SparkSession, str], None]] = {"validate": counts}


def loaded(spark: SparkSession, out: str) -> Frames:
    """The frames in a bundle folder, by source and label or type."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{out}/*/*")
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path)
    names = ["/".join(str(s.getPath()).split("/")[-2:]) for s in found or []]
    return {n: spark.read.parquet(f"{out}/{n}") for n in names}


def chosen(flags: set[str]) -> tuple[list[str], list[str]]:
    """The sources and the maintenance steps of a set of flags."""
    unknown = flags - {"all", *SOURCES, *MAINTENANCE}
    if unknown:
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    every = not flags or "all" in flags
    return [s for s in SOURCES if every or s in flags], [m for m in MAINTENANCE if m in flags]


def load(spark: SparkSession, at: str, out: str, flags: set[str]) -> list[str]:
    """Writes the chosen sources' frames; their names. Each source reads its own folder of the input."""
    sources, steps = chosen(flags)
    written = []
    for source in sources:
        for name, frame in SOURCES[source](spark, f"{at}/{source}").items():
            frame.withColumn("source", F.lit(source)).write.mode("overwrite").parquet(f"{out}/{source}/{name}")
            written.append(f"{source}/{name}")
    for step in steps:
        MAINTENANCE[step](spark, out)
    return written


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Load sources into bundle folders.")
    parser.add_argument("--in", dest="at", required=True)
    parser.add_argument("--out", required=True)
    for flag in ("all", *SOURCES, *MAINTENANCE):
        parser.add_argument(f"--{flag}", action="store_true")
    given = vars(parser.parse_args(args))
    flags = {f for f in ("all", *SOURCES, *MAINTENANCE) if given[f]}
    print("\n".join(load(SparkSession.builder.getOrCreate(), given["at"], given["out"], flags)))


if __name__ == "__main__":
    main()
