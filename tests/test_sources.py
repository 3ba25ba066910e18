"""Readers, loaders and sinks on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import identify, loaders, mapping, readers, sinks
from quillgraph.streaming import event_log


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_delimited_sniffs(spark, tmp_path):
    path = put(tmp_path, "a.tsv", "# note\nx\ty\n1\ta,b\n2\t\n")
    assert rows(readers.delimited(spark, path, comment="#")) == [("1", "a,b"), ("2", None)]


def test_json(spark, tmp_path):
    assert readers.json_records(spark, put(tmp_path, "a.jsonl", '{"a":1}\n{"a":2}\n')).count() == 2
    assert readers.json_records(spark, put(tmp_path, "a.json", '[{"a":1},{"a":2}]'), True).count() == 2


def test_taxonomy_keeps_the_roots_branches(spark, tmp_path):
    nodes = put(tmp_path, "nodes.dmp", "".join(f"{a}\t|\t{b}\t|\t{r}\t|\n" for a, b, r in [(1, 1, "no rank"), (2, 1, "superkingdom"), (9, 2, "genus"), (4751, 2759, "kingdom"), (2759, 1, "superkingdom"), (7, 4751, "species"), (33090, 2759, "kingdom"), (50, 33090, "genus")]))
    names = put(tmp_path, "names.dmp", "2\t|\tBacteria\t|\t\t|\tscientific name\t|\n4751\t|\tFungi\t|\t\t|\tscientific name\t|\n33090\t|\tViridiplantae\t|\t\t|\tscientific name\t|\n33090\t|\tFungi\t|\t\t|\tsynonym\t|\n9\t|\tG\t|\t\t|\tscientific name\t|\n9\t|\tg2\t|\t\t|\tsynonym\t|\n")
    found = loaders.taxa(*readers.taxdump(spark, nodes, names))
    # The plant branch drops out; fungi stay, without the domain above them, which is no group.
    assert {tuple(r) for r in found.select("tax_id", "parent_id", "rank", "name", "kingdom", "genus").na.fill("-").collect()} == {(2, 1, "superkingdom", "Bacteria", "Bacteria", "-"), (7, 4751, "species", "-", "Fungi", "-"), (9, 2, "genus", "G", "Bacteria", "G"), (4751, 2759, "kingdom", "Fungi", "Fungi", "-")}


def test_xml_and_flat_files(spark, tmp_path):
    xml = put(tmp_path, "a.xml", "<all><m><accession>H1</accession><s>x</s><s>y</s></m><m><accession>H2</accession></m></all>")
    assert rows(readers.xml_records(spark, xml, "m").select("accession")) == [("H1",), ("H2",)]
    flat = put(tmp_path, "a.dat", "ENTRY       C1\nNAME        water\n            aqua\n///\nENTRY       C2\n///\n")
    found = readers.flat_records(spark, flat).select(readers.field(F.col("record"), "ENTRY"), readers.field(F.col("record"), "NAME"))
    assert rows(found) == [("C1", "water ; aqua"), ("C2", None)]


def test_genomic_formats(spark, tmp_path):
    vcf = put(tmp_path, "a.vcf", "##x\n#CHROM\n1\t10\t.\tA\tT\t5.0\tPASS\tX=1\n")
    assert rows(readers.vcf(spark, vcf)) == [("1", 10, None, "A", "T", 5.0, "PASS", "X=1")]
    gff = put(tmp_path, "a.gff", "#\nc\ts\tgene\t1\t9\t.\t+\t.\tID=g1;Name=n\nc\ts\tgene\t1\t9\t.\t+\t.\tgene_id \"g2\"; x \"y\";\n")
    assert sorted(r.attributes.get("ID") or r.attributes.get("gene_id") for r in readers.gff(spark, gff).collect()) == ["g1", "g2"]
    assert rows(readers.bed(spark, put(tmp_path, "a.bed", "track x\nc\t1\t5\tn\n"))) == [("c", 1, 5, "n")]
    assert readers.reads(spark, put(tmp_path, "a.fq", "@a\nA\n+\nI\n" * 3), "fastq").first()[0] == 3
    assert readers.reads(spark, put(tmp_path, "a.fa", ">a\nA\n>b\n"), "fasta").first()[0] == 2
    assert readers.reads(spark, put(tmp_path, "a.sam", "@HD\nr1\tx\n"), "sam").first()[0] == 1


def test_matrices(spark, tmp_path):
    one = {"matrix_type": "sparse", "rows": [{"id": "r0"}, {"id": "r1"}], "columns": [{"id": "c0"}], "data": [[0, 0, 2.0], [1, 0, 0.0]]}
    assert rows(readers.biom(spark, put(tmp_path, "a.biom", json.dumps(one)))) == [("r0", "c0", 2.0)]
    dense = one | {"matrix_type": "dense", "data": [[3.0], [0.0]]}
    assert rows(readers.biom(spark, put(tmp_path, "b.biom", json.dumps(dense)))) == [("r0", "c0", 3.0)]
    assert rows(readers.matrix_market(spark, put(tmp_path, "m.mtx", "%%x\n2 2 1\n1 2 4.5\n"))) == [(1, 2, 4.5)]


def test_sql_dump(spark, tmp_path):
    dump = "CREATE TABLE study (\n  tax_id INT,\n  organism VARCHAR(10),\n  PRIMARY KEY (tax_id)\n);\nINSERT INTO study VALUES (1, 'it''s'), (NULL, 'b');\nINSERT INTO other VALUES (9, 'x');\n"
    assert rows(readers.sql_dump(spark, put(tmp_path, "a.sql", dump))) == [("1", "it's"), (None, "b")]


def test_sql_dump_with_a_late_table(spark, tmp_path):
    before = "".join(f"name{i} varchar note;\n-- x\n" for i in range(3000))
    dump = before + "/* a */\nCREATE TABLE IF NOT EXISTS `late` (\n  `a` INT,\n  `b` TEXT\n) ENGINE=X;\nCREATE TABLE more (\n  c INT\n);\nINSERT INTO `late` VALUES (1, 'x');\n"
    found = readers.sql_dump(spark, put(tmp_path, "late.sql", dump))
    assert (found.columns, rows(found)) == (["a", "b"], [("1", "x")])
    with pytest.raises(ValueError, match="CREATE TABLE"):
        readers.sql_dump(spark, put(tmp_path, "none.sql", before))


def test_loaders(spark):
    d = spark.createDataFrame([("E. coli", "562", "Crohn's Disease", None, "Increased", 7), ("x", None, "", None, "", 8)], "microorganism string, ncbi_taxid string, disease string, doid string, qualitative_outcome string, pmid long")
    assert rows(loaders.disbiome(d)) == [("NCBITaxon:562", "E. coli", "disease:crohns_disease", "crohns disease", "enriched", "7")]
    s = spark.createDataFrame([("k__B|s__A_b; C ;;", "1")], "names string, ids string")
    assert rows(loaders.signature_taxa(s, "names", "ids").select("name", "id")) == [("A b", "1"), ("C", "")]
    u = spark.createDataFrame([("UP",), ("Increased",), ("DOWN",)], "d string")
    assert rows(u.select(loaders.signature_direction(F.col("d")))) == [("altered",), ("altered",), ("enriched",)]
    p = spark.createDataFrame([("bact", "dsyn", "CAUSES"), ("bact", "dsyn", "ISA"), ("humn", "dsyn", "CAUSES")], "subject_type string, object_type string, predicate string")
    assert rows(loaders.predications(p).select("direction")) == [("enriched",)]
    m = spark.createDataFrame([("S15-p",), ("K7-m2",), ("bad",)], "r string")
    assert rows(loaders.residues(m, "r").select("site", "ptm")) == [("K7", "methylation"), ("S15", "phosphorylation")]
    a = spark.createDataFrame([("t", "p", "1"), ("t", "p", "3"), ("t", "p", "NA")], "taxon_id string, phenotype string, abundance string")
    assert rows(loaders.abundances(a)) == [("t", "p", 2.0, 1.0, 2)]
    k = spark.createDataFrame([("K1", 5), ("", 6), (None, None)], "inchi_key string, pubchem_cid long")
    assert [r.compound_id for r in loaders.compound_key(k).collect()] == ["K1", "CID:6", None]
    y = spark.createDataFrame([("c", i, "Active" if i % 2 else "No") for i in range(30)], "compound_id string, row int, activity string")
    assert loaders.assays(y).count() == 10
    w = spark.createDataFrame([("Gut Signalling",), ("Other",)], "name string")
    assert rows(loaders.keyword_pathways(w, ["gut"])) == [("Gut Signalling",)]


def test_parquet_adapters(spark, tmp_path):
    spark.createDataFrame([("EFO_1", "ENSG1", 0.5, "x"), ("EFO_2", "ENSG2", 0.1, "x")], "diseaseId string, targetId string, score double, extra string").write.parquet(str(tmp_path / "ot"))
    assert rows(readers.open_targets(spark, str(tmp_path / "ot"))) == [("EFO:1", "ENSEMBL:ENSG1", 0.5)]
    nodes = spark.createDataFrame([(1, "drug"), (2, "disease"), (3, "exposure")], "node_index int, node_type string")
    edges = spark.createDataFrame([(1, 2), (1, 3)], "x_index int, y_index int")
    kept, both = readers.primekg(nodes, edges, {"drug": "Drug", "disease": "Disease"})
    assert kept.count() == 2 and both.count() == 1


def test_bundle_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("Taxon", "a"), ("Drug", "b")], "label string, id string")
    edges = spark.createDataFrame([("X", "a", "b")], "type string, src string, dst string")
    sinks.write_bundle(nodes, edges, str(tmp_path / "b"))
    assert rows(sinks.manifest(spark, str(tmp_path / "b"))) == [("Drug", 1), ("Taxon", 1), ("X", 1)]


def test_stream_takes_each_event_once(spark, tmp_path):
    one = spark.sql("SELECT 1L AS event_id, timestamp'2024-01-01 00:00:01' AS ts, 'a' AS event_type, 2.0D AS value")
    one.unionAll(one).write.parquet(str(tmp_path / "in"))
    stream = event_log.read_log(spark, str(tmp_path / "in"))
    event_log.run_once(event_log.idempotent(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_identifiers_and_archives():
    assert identify.classify("https://zenodo.org/records/123") == ("zenodo", "123")
    assert identify.classify("10.5061/dryad.abc12")[0] == "dryad"
    assert identify.classify("https://example.org/a.csv")[0] == "url"
    with pytest.raises(ValueError):
        identify.classify("file:///etc/passwd")
    assert identify.safe_address("https://x", ["8.8.8.8"]) and not identify.safe_address("https://x", ["10.0.0.1"]) and not identify.safe_address("ftp://x", ["8.8.8.8"])
    assert identify.safe_members([("a/", 0), ("a/b.csv", 3)]) == ["a/b.csv"]
    for bad in ("../x", "/x", "a/../../x", "C:\\x"):
        with pytest.raises(ValueError):
            identify.safe_members([(bad, 1)])


def test_mapping_heuristic(spark):
    columns = spark.createDataFrame([("a", 0, "tax_id"), ("a", 1, "organism_name"), ("a", 2, "log2fc"), ("b", 0, "my_gene"), ("b", 1, "Gene"), ("b", 2, "organism"), ("c", 0, None)], "source string, place int, column string")
    hints = {"Taxon": {"taxon_id": ["tax_id"], "name": ["organism"]}, "Gene": {"symbol": ["gene"]}, "Second": {"symbol": ["gene"]}, "None": {}}
    found = mapping.heuristic(columns, hints)
    assert rows(found) == [("a", "Taxon", "tax_id", "taxon_id", "EXTRACTED"), ("b", "Gene", "Gene", "symbol", "EXTRACTED"), ("b", "Second", "my_gene", "symbol", "INFERRED"), ("b", "Taxon", "organism", "name", "EXTRACTED")]
    assert mapping.heuristic(columns.limit(0), hints).isEmpty()


def test_mapping_documents(spark):
    told = spark.createDataFrame([("Taxon(taxon_id=row.tax id)",), ("Taxon[taxon_id]",), ("A(b=row.c)\n",), ("A(b=row.c) x",), (None,)], "e string")
    assert [r[0] and tuple(r[0]) for r in told.select(mapping.endpoint(F.col("e"))).collect()] == [("Taxon", "taxon_id", "tax id"), None, ("A", "b", "c"), None, None]
    documents = [(1, '{"entities": [{"label": "T"}], "relationships": [{"from": "x", "to": "A(b=row.c)"}]}'), (2, '{"entities": [], "relationships": []}'), (3, "no json"), (4, None), (5, '{"entities": [{"label": "T", "column": "c", "confidence": "SURE"}]}')]
    found = mapping.problems(spark.createDataFrame(documents, "id int, mapping string"))
    assert rows(found) == [(1, "entities/0: column is required"), (1, "relationships/0: not an endpoint: x"), (3, "entities: must be a list"), (4, "entities: must be a list"), (5, "entities/0: unknown confidence SURE")]


def test_mapping_prefixes_and_scores(spark):
    ids = spark.createDataFrame([("chebi:1",), ("chembi:2",), ("CHEMBI:3",), ("zzz:1",), ("plain",), (None,)], "id string")
    registry = spark.createDataFrame([("CHEBI",), ("chebj",)], "prefix string")
    assert sorted(mapping.unknown_prefixes(ids, registry).collect()) == [("chembi", 2, "chebi"), ("zzz", 1, None)]
    pairs = lambda *r: spark.createDataFrame(r, "kind string, x int")
    found = mapping.scores(pairs(("a", 1), ("a", 1), ("a", 2), ("b", 1)), pairs(("a", 1), ("c", 1), ("b", 2)), "kind")
    assert [tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in rows(found)] == [("a", 0.5, 1.0, 0.667), ("b", 0.0, 0.0, 0.0), ("c", 1.0, 0.0, 0.0)]

