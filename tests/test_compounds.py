"""Compound, protein and drug sources on small records, and whole loads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import compounds, load, readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ladder(spark):
    known = spark.createDataFrame(
        [
            ("C1", "H1", "expected", "formate", None, ["x"]),
            ("C2", "H2", "quantified", "Formic acid", None, ["Formate"]),
            ("C3", "H3", "quantified", "Menadione", None, ["Vitamin K2"]),
            ("C4", "H4", "detected", "Vitamin K2", None, None),
            ("C5", "H5", None, "Twin", None, None),
            ("C6", "H6", "predicted", "twin", None, None),
            ("C7", "H7", "quantified", "Acetylglycine", None, ["acetate"]),
            ("C8", "H8", "quantified", "Acetic acid", None, ["acetate"]),
            (None, "H9", "quantified", "lost", None, None),
        ],
        "compound_id string, hmdb_id string, hmdb_status string, name string, iupac_name string, synonyms array<string>",
    )
    names = spark.createDataFrame([(n,) for n in ("Formate", "vitamin k2", "twin", "acetate", "lost", "menadione")], "name string")
    pins = spark.createDataFrame([("acetate", "H8"), ("menadione", "H0")], "name string, hmdb_id string")
    found = dict(rows(compounds.curated_compounds(names, known, pins)))
    # An observed synonym beats a predicted name; an own name beats a synonym; twins and pins to nothing are refused.
    assert found == {"formate": "C2", "vitamin k2": "C4", "twin": None, "acetate": "C8", "lost": None, "menadione": None}


def test_protein_records(spark, tmp_path):
    (tmp_path / "p.dat").write_text(
        "ID   A_HUMAN\nAC   P1; Q9;\nDE   RecName: Full=Alpha one;\nGN   Name=TP; Synonyms=X;\nOS   Homo sapiens\nOS   (Human).\n"
        "DR   Reactome; R-1; Path.\nDR   MIM; 12; phenotype.\nDR   MIM; 13; gene.\nSQ   SEQ\n     MKV\n//\nID   NONE\nDE   RecName: Full=No accession;\n//\n"
    )
    proteins, pathways, phenotypes = compounds.proteins(readers.flat_records(spark, str(tmp_path / "p.dat"), "//"))
    assert rows(proteins) == [("P1", "Alpha one", "TP", "Homo sapiens (Human).")]
    assert (rows(pathways), rows(phenotypes)) == ([("P1", "R-1")], [("P1", "12")])


def test_metabolites_without_filter_keep_all(spark):
    records = spark.createDataFrame([("1", "Hexanoylcarnitine", None, ["Hexanoate"], None), ("2", "Caproic acid", "hexanoic acid", None, "Fatty Acyls"), ("", "no id", None, None, None)], "hmdb_id string, name string, iupac_name string, synonyms array<string>, class string")
    found = compounds.metabolites(records, {"hexanoic acid": 6}, ["Indole"], ["fatty acyls"])
    assert rows(found.select("hmdb_id", "carbon_chain_length", "is_microbial")) == [("1", None, False), ("2", 6, True)]


def test_empty_records(spark):
    none = spark.createDataFrame([], "record array<struct<key:string,value:string>>")
    for frames in (compounds.metacyc(none, none), compounds.proteins(none), compounds.kegg_pathways(none, [])):
        assert all(f.isEmpty() for f in frames)


def test_flags():
    assert load.chosen(set()) == (list(load.SOURCES), [])
    assert load.chosen({"all"})[0] == list(load.SOURCES)
    assert load.chosen({"chembl"}) == (["chembl"], [])
    assert load.chosen({"validate"}) == ([], ["validate"])  # maintenance alone loads nothing
    with pytest.raises(ValueError, match="nothing_such"):
        load.chosen({"nothing_such"})


INPUTS = {
    "taxonomy/nodes.dmp": "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tdomain\t|\n562\t|\t2\t|\tspecies\t|\n3701\t|\t1\t|\tgenus\t|\n",
    "taxonomy/names.dmp": "2\t|\tBacteria\t|\t\t|\tscientific name\t|\n562\t|\tE coli\t|\t\t|\tscientific name\t|\n3701\t|\tArabidopsis\t|\t\t|\tscientific name\t|\n",
    "disbiome/disbiome.jsonl": '{"microorganism":"E coli","ncbi_taxid":"562","disease":"IBD","doid":null,"qualitative_outcome":"Elevated","pmid":1}\n',
    "gutmdisorder/gutmdisorder.tsv": "Gut Microbe\tDisorder\tNCBI ID\tAlteration\tPMID\nE coli\tIBD\t562\tincreased\t1\n",
    "kegg/pathways.txt": "ENTRY       map00010\nNAME        Glycolysis\nCOMPOUND    C00022  Pyruvate\n///\n",
    "chembl/molecule.jsonl": '{"molecule_chembl_id":"M3","pref_name":"three","molecule_type":"Small","max_phase":"4.0"}\n',
    "chembl/mechanism.jsonl": '{"molecule_chembl_id":"M3","target_chembl_id":"T1","action_type":"A","mechanism_of_action":"m"}\n',
    "chembl/target.jsonl": '{"target_chembl_id":"T1","pref_name":"t","target_type":"P","organism":"h","target_components":[{"accession":"U1"}]}\n',
    "metacyc/compounds.dat": "UNIQUE-ID - A\nCOMMON-NAME - a\nINCHI-KEY - InChIKey=K\nIN-PATHWAY - W\n//\n",
    "metacyc/pathways.dat": "UNIQUE-ID - W\nCOMMON-NAME - way\n//\n",
    "uniprot/uniprot.dat": "ID   X\nAC   P1; P2;\nDE   RecName: Full=Alpha one;\nGN   Name=TP;\nOS   Homo sapiens (Human).\nDR   Reactome; R-1; Path.\nDR   MIM; 12; phenotype.\n//\n",
    "bugsigdb/signatures.csv": "# a note\nCondition,Microbe Names,NCBI Taxonomy IDs,Abundance in Group 1,PMID\nIBD,k__B|s__Sp_x;Other one,9,decreased,5\n,Lost,1,increased,6\nAsthma,,1,increased,7\n",
    "semmeddb/predications.csv": "SUBJECT_SEMTYPE,OBJECT_SEMTYPE,PREDICATE,SUBJECT_NAME,OBJECT_NAME,SUBJECT_CUI,OBJECT_CUI,PMID,SENTENCE\nBACT,dsyn,causes,E coli,Crohn's Disease,C1,C2,3,s\nfngs,neop,treats,Some Fungus,Cancer,,,4,\nhumn,dsyn,CAUSES,x,y,,,5,\nbact,dsyn,ISA,x,y,,,6,\nbact,dsyn,CAUSES,,y,,,7,\n",
    "gmrepo/species.jsonl": '{"scientific_name":"E coli","ncbi_taxon_id":562,"phenotype":"IBD","abus_mean":"0.5","abus_sd":"NA","samples":"7","direction":"Increased"}\n{"organism_name":"New one","phenotype":"Asthma","taxon_rank_level":"genus"}\n{"phenotype":"Asthma"}\n{"scientific_name":"x"}\n',
    "mbodymap/mbodymap.csv": "taxon_name,ncbi_tax_id,body_site,relative_abundance,prevalence,health_status\nE coli,562,Gut,0.5,n/a,healthy\nNew one,,gut,x,0.1,\n,7,Skin,,,\n,,Gut,1,1,\nx,1,,1,1,\n",
    "phosphosite/Phosphorylation_site_dataset": "010124\nsome prose\n\nGENE\tPROTEIN\tACC_ID\tORGANISM\tMOD_RSD\tLT_LIT\nTP53\tp53\tP1\thuman\tS15-p\t3\nTP53\tp53\tP1\tHuman\tS15-p\tx\nTP53\tp53\tP1\tmouse\tS15-p\t1\nA\ta\tP2\thuman\tK1-zz\t1\nA\ta\t\thuman\tK1-ac\t1\n",
    "reactome/pathways.txt": "R-1\tTryptophan catabolism\tHomo sapiens\nR-2\tHair growth\tHomo sapiens\n",
    "pubchem/assays.csv": "compound_id,row,activity\nC1,1,Active\nC1,2,Inactive\nC2,1,Active\n",
    "hmdb/metabolites.xml": "<hmdb><metabolite><accession>H1</accession><name>Butyric acid</name><synonyms><synonym>Butanoate</synonym><synonym>x</synonym></synonyms><taxonomy><class>Fatty Acyls</class></taxonomy></metabolite><metabolite><accession>H2</accession><name>Glucose</name></metabolite></hmdb>",
    "pubmed/articles.jsonl": '{"pmid":"1","title":"t","abstract":"a","headings":["IBD"," ","Asthma"]}\n{"pmid":"2","title":"u","abstract":null,"headings":null}\n{"title":"no number"}\n',
    "metabolights/studies.jsonl": '{"id":"S1","samples":[{"id":"a","measurements":[{"compound":"C1","value":"1.5"},{"compound":"C2","value":"nd"},{"value":"2"}]},{"id":"b","measurements":[]}]}\n{"id":"S2"}\n',
}
LOADED = {
    "taxonomy/Taxon": 2, "disbiome/ASSOCIATED_WITH_DISEASE": 1, "gutmdisorder/ASSOCIATED_WITH_DISEASE": 1, "kegg/Pathway": 1, "chembl/Drug": 1, "chembl/Protein": 1, "chembl/TARGETS": 1,
    "metacyc/Compound": 1, "metacyc/Pathway": 1, "metacyc/PARTICIPATES_IN": 1, "uniprot/Protein": 1, "uniprot/PARTICIPATES_IN": 1, "uniprot/LINKED_TO_PHENOTYPE": 1, "bugsigdb/ASSOCIATED_WITH_DISEASE": 2,
    "semmeddb/ASSOCIATED_WITH_DISEASE": 2, "gmrepo/ASSOCIATED_WITH_DISEASE": 2, "mbodymap/BodySite": 2, "mbodymap/FOUND_IN": 3, "phosphosite/Modification": 1, "phosphosite/HAS_MODIFICATION": 1, "reactome/Pathway": 1,
    "pubchem/TESTED_IN": 2, "hmdb/Compound": 2, "pubmed/Paper": 2, "pubmed/MENTIONED_IN": 2, "metabolights/MEASURED_IN": 2, "opentargets/ASSOCIATED_WITH_TARGET": 1,
}


def test_every_flag_loads(spark, tmp_path):
    at, out = tmp_path / "in", str(tmp_path / "out")
    for name, text in INPUTS.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text)
    scored = spark.createDataFrame([("EFO_1", "ENSG1", 0.9), ("EFO_2", "ENSG1", 0.1)], "diseaseId string, targetId string, score double")
    scored.write.parquet(str(at / "opentargets" / "associations"))
    for source in load.SOURCES:
        load.load(spark, str(at), out, {source})
    found = load.loaded(spark, out)
    assert {k: f.count() for k, f in found.items() if k != "kegg/PARTICIPATES_IN"} == LOADED
    told = lambda name, *c: rows(found[name].select(*c))
    assert told("taxonomy/Taxon", "tax_id", "name") == [(2, "Bacteria"), (562, "E coli")]  # the plant branch drops out
    assert told("bugsigdb/ASSOCIATED_WITH_DISEASE", "taxon_id", "taxon_name", "name_normalized", "direction") == [("NCBITaxon:9", "Sp x", "inflammatory bowel disease", "depleted"), ("bugsigdb:other_one", "Other one", "inflammatory bowel disease", "depleted")]
    assert told("semmeddb/ASSOCIATED_WITH_DISEASE", "taxon_id", "disease_id", "direction") == [("UMLS:C1", "UMLS:C2", "enriched"), ("semmeddb:some_fungus", "disease:cancer", "depleted")]
    assert told("gmrepo/ASSOCIATED_WITH_DISEASE", "taxon_id", "rank", "direction", F.col("abundance_mean").cast("string"), F.col("abundance_std").isNull(), F.coalesce("samples", F.lit(0))) == [("NCBITaxon:562", "species", "enriched", "0.5", True, 7), ("gmrepo:new_one", "genus", "altered", None, True, 0)]
    assert told("mbodymap/FOUND_IN", "src", "dst", "taxon_name") == [("NCBITaxon:562", "bodysite:gut", "E coli"), ("NCBITaxon:7", "bodysite:skin", "7"), ("mbodymap:new_one", "bodysite:gut", "New one")]
    assert told("phosphosite/Modification", "modification_id", "evidence_count") == [("P1:phosphorylation:S15", 3)]
    assert told("hmdb/Compound", "hmdb_id", "is_scfa") == [("H1", True), ("H2", False)]
    assert told("pubmed/MENTIONED_IN", "src", "dst") == [("disease:asthma", "PMID:1"), ("disease:inflammatory_bowel_disease", "PMID:1")]
    assert told("metabolights/MEASURED_IN", "sample", "compound", F.coalesce("value", F.lit(-1.0))) == [("a", "C1", 1.5), ("a", "C2", -1.0)]


def test_a_header_below_prose(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("prose\n\nother\tX\n")
    with pytest.raises(ValueError, match="GENE"):
        readers.headed(spark, str(tmp_path / "a.tsv"), "GENE")


def test_load_twice_is_the_same(spark, tmp_path, capsys):
    at = tmp_path / "in"
    (at / "metacyc").mkdir(parents=True)
    (at / "metacyc" / "compounds.dat").write_text("# note\nUNIQUE-ID - A\nCOMMON-NAME - a\nINCHI-KEY - InChIKey=K\nIN-PATHWAY - W\nIN-PATHWAY - V\n//\nUNIQUE-ID - B\nCOMMON-NAME - b\nIN-PATHWAY - W\n//\n")
    (at / "metacyc" / "pathways.dat").write_text("UNIQUE-ID - W\nCOMMON-NAME - way\n//\n")
    (at / "gutmdisorder").mkdir()
    (at / "gutmdisorder" / "gutmdisorder.tsv").write_text("Gut Microbe\tDisorder\tNCBI ID\tAlteration\tPMID\nE coli\tIBD\t562\tincreased\t1\nX\t\t1\tlower\t2\n")
    out = str(tmp_path / "out")
    for _ in range(2):
        assert load.load(spark, str(at), out, {"metacyc", "gutmdisorder"}) == ["gutmdisorder/ASSOCIATED_WITH_DISEASE", "metacyc/Compound", "metacyc/Pathway", "metacyc/PARTICIPATES_IN"]
    found = load.loaded(spark, out)
    assert rows(found["metacyc/PARTICIPATES_IN"]) == [("INCHIKEY:K", "METACYC:V", "metacyc"), ("INCHIKEY:K", "METACYC:W", "metacyc")]
    assert rows(found["gutmdisorder/ASSOCIATED_WITH_DISEASE"].select("taxon_id", "name_normalized", "direction")) == [("NCBITaxon:562", "inflammatory bowel disease", "enriched")]
    assert load.load(spark, str(at), out, {"validate"}) == []
    assert "metacyc/Compound 1" in capsys.readouterr().out


def test_drug_without_mechanism_stays(spark):
    molecules = spark.createDataFrame([("M1", None, None, "4"), ("M2", "two", "Small", "3"), ("M3", "three", "Small", "4.0")], "molecule_chembl_id string, pref_name string, molecule_type string, max_phase string")
    mechanisms = spark.createDataFrame([("M3", "T1", "B", "m"), ("M3", "T1", "A", "m"), ("M2", "T1", "A", "m"), ("M3", "T9", "A", "m")], "molecule_chembl_id string, target_chembl_id string, action_type string, mechanism_of_action string")
    targets = spark.createDataFrame([("T1", "t", "P", "h", [("U1",), (None,)]), ("T2", "u", "P", "h", [])], "target_chembl_id string, pref_name string, target_type string, organism string, target_components array<struct<accession:string>>")
    drugs, proteins, edges = compounds.drug_targets(molecules, mechanisms, targets)
    assert rows(drugs.select("drug_id", "name", "drug_type")) == [("CHEMBL:M1", "M1", "Unknown"), ("CHEMBL:M3", "three", "Small")]
    assert rows(edges) == [("CHEMBL:M3", "CHEMBL:T1", "A", "m")]
    assert rows(proteins.select("protein_id", F.col("uniprot_ids").cast("string"))) == [("CHEMBL:T1", "[U1]")]
