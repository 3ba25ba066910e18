"""Derivation, deduplication, upserts and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.lineage import scratch
from quillgraph.functions.text import collapse_key, full_match, joined_set
from quillgraph.operators import curate
from quillgraph.operators.quality import id_consistency, invariants, source_coverage
from quillgraph.operators.upsert import association_rules, first_written, folded_associations, merged
from quillgraph.plans.registry import query
from quillgraph.plans.views import Graph
from quillgraph.sources.compounds import curated_compounds
from quillgraph.sources.store import Store

#: A total order of lines, whatever the size of their keys.
LINE_ORDER = "l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, l_returnflag, l_linestatus"

IMPLICATED = """SELECT pathway_id, disease_id, count(DISTINCT compound_id) AS support FROM participates JOIN linked USING (compound_id)
    WHERE compound_id IN (SELECT compound_id FROM participates GROUP BY 1 HAVING count(DISTINCT pathway_id) <= 14) GROUP BY 1, 2 HAVING count(DISTINCT compound_id) >= 2"""


@query(IMPLICATED)
def d1_implicated_in(g: Graph) -> DataFrame:
    return curate.implicated(g.participates, g.linked, 14, 2)


@query(f"SELECT DISTINCT p.pathway_id, l.disease_id FROM participates p JOIN linked l USING (compound_id) JOIN ({IMPLICATED}) i ON i.pathway_id = p.pathway_id AND i.disease_id = l.disease_id")
def d2_stale_cleanup(g: Graph) -> DataFrame:
    stored = g.participates.join(g.linked, "compound_id").select("pathway_id", "disease_id").distinct()
    return curate.without_stale(stored, curate.implicated(g.participates, g.linked, 14, 2), ["pathway_id", "disease_id"])


@query("SELECT gene_name AS gene, count(*) AS encoded, min(protein_id) AS first_protein FROM protein WHERE gene_name <> '' GROUP BY 1")
def d3_genes_from_proteins(g: Graph) -> DataFrame:
    return g.protein.filter("gene_name != ''").groupBy(F.col("gene_name").alias("gene")).agg(F.count(F.lit(1)).alias("encoded"), F.min("protein_id").alias("first_protein"))


@query("SELECT lower(trim(p_name)) || '/' || p_brand AS key, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), '|' ORDER BY CAST(p_partkey AS VARCHAR)) AS ids FROM part GROUP BY 1 HAVING count(*) > 1")
def d4_duplicate_names(g: Graph) -> DataFrame:
    return curate.duplicate_groups(g.table("part"), F.concat_ws("/", F.lower(F.trim("p_name")), "p_brand"), "p_partkey")


@query("SELECT CAST(p_retailprice AS VARCHAR) AS key, count(*) AS n, string_agg('C:' || p_partkey, '|' ORDER BY 'C:' || p_partkey) AS ids FROM (SELECT CAST(round(p_retailprice) AS BIGINT) AS p_retailprice, p_partkey FROM part WHERE p_size <= 45) GROUP BY 1 HAVING count(*) > 1")
def d5_duplicate_ids(g: Graph) -> DataFrame:
    rows = g.table("part").filter("p_size <= 45").select(F.round("p_retailprice").cast("long").cast("string").alias("price"), F.concat(F.lit("C:"), F.col("p_partkey").cast("string")).alias("id"))
    return curate.duplicate_groups(rows, F.col("price"), "id")


@query("""SELECT DISTINCT taxon_id, k AS compound_id FROM produces JOIN (SELECT compound_id, first_value(compound_id) OVER (PARTITION BY name, category ORDER BY chain, compound_id) AS k FROM compound) USING (compound_id)""")
def d6_merge_nodes(g: Graph) -> DataFrame:
    """Edges re-pointed to the node that each group keeps."""
    nodes = g.compound.withColumn("group", F.concat_ws("/", "name", "category"))
    ids = curate.keepers(nodes, "group", [F.col("chain"), F.col("compound_id")], "compound_id")
    return curate.repointed(g.produces.select("taxon_id", "compound_id"), ids, "compound_id")


@query("SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS removed FROM (SELECT name, category, count(*) AS n FROM compound GROUP BY 1, 2 HAVING count(*) > 1)")
def d7_dedup_report(g: Graph) -> DataFrame:
    groups = g.compound.groupBy("name", "category").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("removed"))


@query("""WITH n AS (SELECT p_name || CASE WHEN p_size % 2 = 0 THEN 's' ELSE '' END AS norm, count(DISTINCT p_brand) AS weight FROM part GROUP BY 1),
          k AS (SELECT CASE WHEN length(split_part(norm, ' ', 2)) > 3 AND norm LIKE '%s' THEN left(norm, length(norm) - 1) ELSE norm END AS key, norm, weight FROM n)
          SELECT key, string_agg(norm, '|' ORDER BY weight DESC, norm) AS members FROM k GROUP BY 1 HAVING count(DISTINCT norm) >= 2""")
def d8_collapse_near_duplicates(g: Graph) -> DataFrame:
    names = g.table("part").select(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "s").otherwise("")).alias("norm"), "p_brand")
    weighed = names.groupBy("norm").agg(F.countDistinct("p_brand").alias("weight"))
    plan = curate.collapse_plan(weighed, collapse_key(F.col("norm")), "norm", "weight")
    return plan.select("key", F.concat_ws("|", "canonical", "duplicates").alias("members"))


@query("""WITH k AS (SELECT 'C:' || p_partkey AS id, p_brand AS hmdb, p_size % 3 = 0 AS seen, p_partkey AS p FROM part),
          c AS (SELECT id, hmdb, seen, p AS n, 0 AS tier FROM k WHERE p % 3 <> 0 UNION ALL SELECT id, hmdb, seen, p + 1, 1 FROM k WHERE p % 4 = 0 UNION ALL SELECT id, hmdb, seen, p + 2, 2 FROM k UNION ALL SELECT id, hmdb, seen, p // 2, 2 FROM k),
          m AS (SELECT n, id, hmdb, seen, min(tier) AS tier FROM c GROUP BY 1, 2, 3, 4),
          r AS (SELECT n, id, CASE WHEN n % 10 = 0 THEN 0 WHEN seen THEN tier ELSE 10 + tier END AS place FROM m WHERE n % 10 <> 0 OR hmdb = 'Brand#' || (n % 25)),
          t AS (SELECT n, min(id) AS id, count(DISTINCT id) AS q FROM r JOIN (SELECT n, min(place) AS best FROM r GROUP BY 1) b USING (n) WHERE place = best GROUP BY 1)
          SELECT lower(c_name) AS name, CASE WHEN q = 1 THEN id END AS compound_id FROM customer LEFT JOIN t ON n = c_custkey""")
def d9_curated_resolution(g: Graph) -> DataFrame:
    """Customers as curated names; parts claim them by own, systematic and synonymous names, and some names are pinned."""
    part, people = g.table("part"), g.table("customer")
    name = lambda prefix, n: F.concat(F.lit(prefix), F.lpad(n.cast("string"), 9, "0"))
    p = F.col("p_partkey")
    known = part.select(
        F.concat(F.lit("C:"), p.cast("string")).alias("compound_id"),
        F.col("p_brand").alias("hmdb_id"),
        F.when(F.col("p_size") % 3 == 0, "Detected ").when(F.col("p_size") % 3 == 1, "predicted").alias("hmdb_status"),
        F.when(p % 3 != 0, name("Customer#", p)).alias("name"),
        F.when(p % 4 == 0, name("CUSTOMER#", p + 1)).alias("iupac_name"),
        F.array(name("Customer#", p + 2), name("customer#", F.floor(p / 2))).alias("synonyms"),
    )
    pins = people.filter("c_custkey % 10 = 0").select(F.col("c_name").alias("name"), F.concat(F.lit("Brand#"), (F.col("c_custkey") % 25).cast("string")).alias("hmdb_id"))
    return curated_compounds(people.select(F.col("c_name").alias("name")), known, pins)


@query("SELECT disease_id, coalesce(doid, CASE WHEN category = 'BUILDING' THEN 'curated' ELSE 'legacy' END) AS source FROM disease")
def d10_backfill(g: Graph) -> DataFrame:
    return g.disease.select("disease_id", F.coalesce("doid", F.when(F.col("category") == "BUILDING", "curated").otherwise("legacy")).alias("source"))


@query("SELECT compound_id, name IN ('red bolt', 'small ring', 'hot gear') AS is_scfa FROM compound")
def d11_flag_repair(g: Graph) -> DataFrame:
    return g.compound.select("compound_id", F.col("name").isin("red bolt", "small ring", "hot gear").alias("is_scfa"))


@query("SELECT doc_id, CASE WHEN taken IS NULL THEN 'PMID:' || want END AS paper_id FROM (SELECT d.doc_id, d.doc_id // 2 AS want, t.doc_id AS taken FROM documents d LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) t ON t.doc_id = d.doc_id // 2)")
def d12_paper_ids(g: Graph) -> DataFrame:
    """A paper gets its id unless another has it already."""
    docs = g.table("documents").select("doc_id", F.floor(F.col("doc_id") / 2).cast("long").alias("want"))
    taken = g.table("documents").select(F.col("doc_id").alias("taken")).filter("taken % 3 = 0")
    joined = docs.join(taken, F.col("want") == F.col("taken"), "left")
    return joined.select("doc_id", F.when(F.col("taken").isNull(), F.concat(F.lit("PMID:"), F.col("want").cast("string"))).alias("paper_id"))


OLD = "(SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 0)"
NEW = "(SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE lower(c_mktsegment) END AS segment FROM customer WHERE c_custkey % 7 <> 0)"
STATE = "CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL THEN 'matched' WHEN n.id IS NOT NULL THEN 'created' ELSE 'kept' END AS state"


def old_new(g: Graph) -> tuple[DataFrame, DataFrame]:
    rows = g.table("customer").withColumnRenamed("c_custkey", "id")
    old = rows.filter("id % 5 != 0").select("id", F.col("c_name").alias("name"), F.when(F.col("id") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    new = rows.filter("id % 7 != 0").select("id", F.upper("c_name").alias("name"), F.when(F.col("id") % 4 != 0, F.lower("c_mktsegment")).alias("segment"))
    return old, new


@query(f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, coalesce(o.segment, n.segment) AS segment, {STATE} FROM {OLD} o FULL JOIN {NEW} n ON o.id = n.id")
def w1_merge_nodes(g: Graph) -> DataFrame:
    return merged(*old_new(g), ["id"], {"name": "newest", "segment": "keep"})


#: What a line says of a taxon and a disease; chunk 1 comes to the store when chunk 0 is in it.
CLAIM = """SELECT 'S:' || l_suppkey AS taxon_id, 'D:' || o_custkey AS disease_id, 'src' || (l_linenumber % 4) AS source, CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_orderkey AS VARCHAR) ELSE '' END AS pmid,
    CASE l_returnflag WHEN 'A' THEN 'enriched' WHEN 'R' THEN 'depleted' ELSE 'altered' END AS direction, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity <= 25 THEN 0 ELSE 1 END AS chunk
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
PAIR = ["taxon_id", "disease_id"]


def claims(g: Graph) -> DataFrame:
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    lines = g.table("lineitem").join(g.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        text("S:", "l_suppkey").alias("taxon_id"),
        text("D:", "o_custkey").alias("disease_id"),
        F.concat(F.lit("src"), (F.col("l_linenumber") % 4).cast("string")).alias("source"),
        F.when(F.col("l_partkey") % 10 != 0, F.col("l_orderkey").cast("string")).otherwise("").alias("pmid"),
        F.when(F.col("l_returnflag") == "A", "enriched").when(F.col("l_returnflag") == "R", "depleted").otherwise("altered").alias("direction"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_quantity") <= 25, 0).otherwise(1).alias("chunk"),
    )


@query(f"""WITH c AS ({CLAIM}), s AS (SELECT taxon_id, disease_id, string_agg(source, '|' ORDER BY chunk, seq) AS sources FROM (SELECT taxon_id, disease_id, source, min((chunk, seq))[1] AS chunk, min((chunk, seq))[2] AS seq FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2)
          SELECT taxon_id, disease_id, sources, CAST(count(DISTINCT nullif(pmid, '')) AS BIGINT) AS n_pmids, CAST(CASE WHEN count(*) = 1 THEN 1 ELSE count(DISTINCT nullif(pmid, '')) END AS BIGINT) AS n_studies, arg_min(direction, (chunk, seq, direction)) AS direction,
                 CASE WHEN min(chunk) = max(chunk) THEN CASE WHEN min(chunk) = 0 THEN 'kept' ELSE 'created' END ELSE 'matched' END AS state FROM c JOIN s USING (taxon_id, disease_id) GROUP BY 1, 2, 3""")
def w2_association_upsert(g: Graph) -> DataFrame:
    """Claims merged into a stored frame in two chunks, the first of them sent again: sources and papers are appended
    if absent, studies counted by papers, the first direction stays."""
    schema = "taxon_id string, disease_id string, direction string, sources array<string>, pmids array<string>, n_studies long"
    store = Store(g.spark, scratch(g.spark), schema, PAIR, association_rules())
    for chunk in (0, 1, 0):
        store.merge(folded_associations(claims(g).filter(F.col("chunk") == chunk), PAIR, "seq"), f"lines-{chunk}")
    rows = store.read_states()
    return rows.select(*PAIR, F.concat_ws("|", "sources").alias("sources"), F.size("pmids").cast("long").alias("n_pmids"), "n_studies", "direction", "state")


@query(f"SELECT coalesce(o.id, n.id) AS id, coalesce(o.segment, n.segment) AS segment, {STATE} FROM {OLD} o FULL JOIN {NEW} n ON o.id = n.id")
def w3_fill_null(g: Graph) -> DataFrame:
    return merged(*old_new(g), ["id"], {"segment": "keep"})


@query(f"SELECT coalesce(o.id, n.id) AS id, coalesce(n.segment, o.segment) AS segment, {STATE} FROM {OLD} o FULL JOIN {NEW} n ON o.id = n.id")
def w4_overwrite_present(g: Graph) -> DataFrame:
    return merged(*old_new(g), ["id"], {"segment": "replace"})


@query("SELECT c_custkey AS id, array_to_string(list_filter(['a', 'b', 'c'], lambda x: x <> chr(CAST(97 + c_custkey % 4 AS INTEGER))), '|') || '|' || chr(CAST(97 + c_custkey % 4 AS INTEGER)) AS sources FROM customer")
def w5_move_to_end(g: Graph) -> DataFrame:
    new = F.char((F.lit(97) + F.col("c_custkey") % 4).cast("long"))
    sources = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return g.table("customer").select(F.col("c_custkey").alias("id"), F.array_join(F.array_append(F.array_remove(sources, new), new), "|").alias("sources"))


@query("SELECT label, count(*) AS rows, CAST(ceil(count(*) / 10000.0) AS BIGINT) AS chunks FROM nodes GROUP BY 1")
def w7_dry_run_counts(g: Graph) -> DataFrame:
    n = F.count(F.lit(1))
    return g.nodes.groupBy("label").agg(n.alias("rows"), F.ceil(n / 10000.0).alias("chunks"))


@query("SELECT taxon_id, disease_id, CASE WHEN source = 'src1' THEN 'reviewed' ELSE source END AS source FROM assoc WHERE NOT (direction = 'altered' AND n_studies < 2)")
def w8_guarded_write(g: Graph) -> DataFrame:
    """A delete and a property change by selector, as a rewrite of the frame."""
    kept = g.assoc.filter(~((F.col("direction") == "altered") & (F.col("n_studies") < 2)))
    return kept.select("taxon_id", "disease_id", F.when(F.col("source") == "src1", "reviewed").otherwise(F.col("source")).alias("source"))


@query("SELECT label, count(*) AS kept, (SELECT count(*) FROM nodes x WHERE x.label = n.label AND org = 'ASIA') AS removed FROM nodes n WHERE org IS DISTINCT FROM 'ASIA' GROUP BY label")
def w9_org_delete(g: Graph) -> DataFrame:
    gone = F.coalesce(F.col("org") == "ASIA", F.lit(False))
    return g.nodes.groupBy("label").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("removed"))


@query("SELECT l_orderkey AS sample, l_partkey AS taxon, min_by(l_quantity, row(l_linenumber, l_suppkey, l_quantity)) AS abundance FROM lineitem GROUP BY 1, 2")
def w10_sample_composition(g: Graph) -> DataFrame:
    """Lists of (taxon, abundance) taken apart again: the first entry of each pair is written."""
    rows = g.table("lineitem").withColumn("seq", F.struct("l_linenumber", "l_suppkey", "l_quantity"))
    lists = rows.groupBy(F.col("l_orderkey").alias("sample")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("taxon"), F.col("l_quantity").alias("abundance"), "seq")).alias("items"))
    return first_written(lists.select("sample", F.inline("items")), ["sample", "taxon"], "seq", ["abundance"])


@query("SELECT label, count(*) AS missing FROM nodes WHERE org IS NULL GROUP BY 1")
def v1_missing_org(g: Graph) -> DataFrame:
    return g.nodes.filter("org IS NULL").groupBy("label").agg(F.count(F.lit(1)).alias("missing"))


@query("SELECT label, count(*) AS orphans FROM nodes WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges) GROUP BY 1")
def v2_orphans(g: Graph) -> DataFrame:
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return g.nodes.join(ends, "id", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("orphans"))


@query("""WITH t AS (SELECT CASE ncbi_tax_id % 50 WHEN 1 THEN ncbi_tax_id - 1 WHEN 2 THEN NULL ELSE ncbi_tax_id END AS id FROM taxon), c AS (SELECT id, count(*) AS n FROM t WHERE id IS NOT NULL GROUP BY 1)
          SELECT (SELECT count(*) FROM t) AS total, (SELECT count(*) FROM t WHERE id IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS sharing FROM c""")
def v3_taxonomy_ids(g: Graph) -> DataFrame:
    """Some taxa are given their neighbour's identifier, some none."""
    n = F.col("ncbi_tax_id")
    return id_consistency(g.taxon.select(F.when(n % 50 == 1, n - 1).when(n % 50 != 2, n).alias("id")), "id")


@query("SELECT count(*) FILTER (regexp_full_match(hmdb_id, 'Brand#\\d')) AS short, count(*) FILTER (NOT regexp_full_match(hmdb_id, 'Brand#\\d+')) AS malformed, count(*) FILTER (hmdb_id IS NULL) AS missing FROM compound".replace("\\\\", "\\"))
def v4_id_formats(g: Graph) -> DataFrame:
    ok = lambda p: full_match(F.col("hmdb_id"), p)
    return g.compound.agg(F.count_if(ok(r"Brand#\d")).alias("short"), F.count_if(~ok(r"Brand#\d+")).alias("malformed"), F.count_if(F.col("hmdb_id").isNull()).alias("missing"))


RULES = [("HAS_PARENT", "Taxon", "Taxon"), ("PRODUCES", "Taxon", "Compound"), ("PARTICIPATES_IN", "Compound", "Pathway"), ("EFFECTIVE_AGAINST", "Drug", "Disease"), ("TESTED_IN", "Compound", "Assay")]
RULES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RULES) + ") r(type, a, b)"


def rules(g: Graph) -> DataFrame:
    return g.spark.createDataFrame(RULES, "type string, a string, b string")


@query(f"SELECT e.type, s.label AS src_label, d.label AS dst_label, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes d ON d.id = e.dst JOIN {RULES_SQL} ON r.type = e.type WHERE s.label <> r.a OR d.label <> r.b GROUP BY 1, 2, 3")
def v5_endpoint_labels(g: Graph) -> DataFrame:
    """Edges whose ends have other labels than the rule of their type says."""
    src, dst = (g.nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")) for end in ("src", "dst"))
    rows = g.edges.join(F.broadcast(rules(g)), "type").join(src, "src").join(dst, "dst")  # five rules
    return rows.filter("src_label != a OR dst_label != b").groupBy("type", "src_label", "dst_label").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT coalesce(e.type, r.type) AS type, CASE WHEN e.type IS NULL THEN 'vacuous' WHEN r.type IS NULL THEN 'unruled' ELSE 'ruled' END AS coverage FROM (SELECT DISTINCT type FROM edges) e FULL JOIN {RULES_SQL} ON r.type = e.type")
def v6_rule_coverage(g: Graph) -> DataFrame:
    seen = g.edges.select("type").distinct().withColumn("seen", F.lit(1))
    coverage = F.when(F.col("seen").isNull(), "vacuous").when(F.col("a").isNull(), "unruled").otherwise("ruled")
    return seen.join(rules(g), "type", "full").select("type", coverage.alias("coverage"))


@query("""WITH r AS (SELECT label AS part, org AS source FROM nodes UNION ALL SELECT 'ASSOCIATED_WITH_DISEASE', source FROM assoc UNION ALL SELECT 'PRODUCES', org FROM produces UNION ALL SELECT 'EFFECTIVE_AGAINST', org FROM effective)
          SELECT part, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(*) AS n, count(source) AS with_source FROM r GROUP BY 1""")
def v7_source_coverage(g: Graph) -> DataFrame:
    """Every label of nodes, and every type of edge that says where it is from."""
    said = lambda frame, kind, source: frame.select(F.lit(kind).alias("part"), F.col(source).alias("source"))
    edges = said(g.assoc, "ASSOCIATED_WITH_DISEASE", "source").unionAll(said(g.produces, "PRODUCES", "org")).unionAll(said(g.effective, "EFFECTIVE_AGAINST", "org"))
    return source_coverage(g.nodes.select(F.col("label").alias("part"), F.col("org").alias("source")).unionAll(edges))


@query("SELECT (SELECT count(*) FROM (SELECT 1 FROM disease GROUP BY name_normalized HAVING count(*) > 1)) AS duplicate_diseases, (SELECT count(*) FROM disease WHERE name_normalized IS NULL) AS missing_norm, (SELECT count(*) FROM assoc WHERE source IS NULL) AS untracked, (SELECT count(*) FROM disease) AS diseases")
def v8_graph_validation(g: Graph) -> DataFrame:
    norms = g.disease.groupBy("name_normalized").agg(F.count(F.lit(1)).alias("n"))
    one = norms.agg(F.count_if((F.col("n") > 1)).alias("duplicate_diseases"), F.coalesce(F.sum(F.when(F.col("name_normalized").isNull(), F.col("n"))), F.lit(0)).alias("missing_norm"), F.sum("n").alias("diseases"))
    edges = g.assoc.agg(F.count_if(F.col("source").isNull()).alias("untracked"))
    return one.withColumn("k", F.lit(1)).join(edges.withColumn("k", F.lit(1)), "k").select("duplicate_diseases", "missing_norm", "untracked", "diseases")


@query("""SELECT 'self_parent' AS invariant, count(*) AS violations FROM edges WHERE type = 'HAS_PARENT' AND src = dst UNION ALL SELECT 'dangling_edge', count(*) FROM edges WHERE dst NOT IN (SELECT id FROM nodes)
          UNION ALL SELECT 'duplicate_edge', count(*) FROM (SELECT 1 FROM edges GROUP BY src, dst, type HAVING count(*) > 1) UNION ALL SELECT 'negative_studies', count(*) FROM assoc WHERE n_studies < 1 UNION ALL SELECT 'unknown_direction', count(*) FROM assoc WHERE direction NOT IN ('enriched', 'depleted', 'altered')
          UNION ALL SELECT 'two_parents', count(*) FROM (SELECT 1 FROM edges WHERE type = 'HAS_PARENT' GROUP BY src HAVING count(*) > 1) UNION ALL SELECT 'nameless', count(*) FROM nodes WHERE name IS NULL OR name = '' UNION ALL SELECT 'duplicate_node', count(*) FROM (SELECT 1 FROM nodes GROUP BY id HAVING count(*) > 1)""")
def v9_invariants(g: Graph) -> DataFrame:
    return invariants(g.nodes, g.edges, g.assoc)
