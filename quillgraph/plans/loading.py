"""Loader transforms, name index, bundles and mapping rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.lineage import scratch
from quillgraph.functions.text import normal_disease
from quillgraph.plans.provenance import CHAIN, chains
from quillgraph.plans.registry import query
from quillgraph.plans.views import Graph
from quillgraph.sources import loaders, mapping
from quillgraph.sources.store import Store


@query("SELECT gene_name AS gene, count(*) AS proteins, (SELECT count(DISTINCT pathway_id) FROM gene_pathway x WHERE x.gene = 'Brand#7') AS pathways FROM protein WHERE gene_name = 'Brand#7' GROUP BY 1")
def l14_get_gene(g: Graph) -> DataFrame:
    one = g.protein.filter("gene_name = 'Brand#7'").groupBy(F.col("gene_name").alias("gene")).agg(F.count(F.lit(1)).alias("proteins"))
    return one.join(g.gene_pathway.filter("gene = 'Brand#7'").groupBy("gene").agg(F.countDistinct("pathway_id").alias("pathways")), "gene")


@query("SELECT p.paper_id, p.year, p.year / 10 AS relevance FROM mention m JOIN paper p USING (paper_id) WHERE m.entity_id = 'S:11' AND p.year / 10 >= 200 ORDER BY relevance DESC, p.paper_id LIMIT 20")
def l18_papers_for_taxon(g: Graph) -> DataFrame:
    rows = g.mention.filter("entity_id = 'S:11'").join(g.paper.select("paper_id", "year"), "paper_id").withColumn("relevance", F.col("year") / 10)
    return rows.filter("relevance >= 200").select("paper_id", "year", "relevance").orderBy(F.col("relevance").desc(), "paper_id").limit(20)


@query("SELECT token, count(*) AS postings, min(id) AS first_id FROM (SELECT DISTINCT unnest(string_split(lower(name), ' ')) AS token, id FROM nodes) GROUP BY 1")
def r8_name_index(g: Graph) -> DataFrame:
    """A tokenised inverted index over names: postings a token."""
    tokens = g.nodes.select(F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("token"), "id").distinct()
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("postings"), F.min("id").alias("first_id"))


@query("SELECT label AS part, count(*) AS rows FROM nodes GROUP BY 1 UNION ALL SELECT type, count(*) FROM edges GROUP BY 1")
def w6_bundle_submit(g: Graph) -> DataFrame:
    """A bundle sent to stored frames in chunks, one of them twice, and counted by label and type."""
    nodes = Store(g.spark, scratch(g.spark), "label string, id string, name string, org string", ["label", "id"], {"name": "newest", "org": "newest"})
    edges = Store(g.spark, scratch(g.spark), "type string, src string, dst string, times long", ["type", "src", "dst"], {"times": "newest"})
    pairs = g.edges.groupBy("type", "src", "dst").agg(F.count(F.lit(1)).alias("times"))
    for k in (0, 1, 0):
        nodes.merge(g.nodes.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == k), f"nodes-{k}")
        edges.merge(pairs.filter(F.pmod(F.xxhash64("src"), F.lit(2)) == k), f"edges-{k}")
    counted = nodes.read().groupBy(F.col("label").alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.unionByName(edges.read().groupBy(F.col("type").alias("part")).agg(F.sum("times").alias("rows")))


HINTS = {"Fastener": {"bolt_id": ["red_bolt"], "name": ["bolt"]}, "Ring": {"ring": ["ring", "small_ring"]}, "Other": {"other": ["ring"]}}
PICKED = "SELECT p_brand AS source, min(col) FILTER (col = 'red_bolt') AS red, min(col) FILTER (contains(col, 'bolt')) AS bolt, min(col) FILTER (col = 'small_ring') AS small, min(col) FILTER (contains(col, 'ring')) AS ring FROM (SELECT p_brand, replace(p_name, ' ', '_') AS col FROM part) GROUP BY 1"


@query(f"""WITH p AS ({PICKED}), f AS (SELECT *, coalesce(small, ring) AS own FROM p),
          o AS (SELECT p_brand AS source, min(replace(p_name, ' ', '_')) AS other FROM part JOIN f ON source = p_brand WHERE contains(p_name, 'ring') AND replace(p_name, ' ', '_') <> own GROUP BY 1)
          SELECT source, 'Fastener' AS label, coalesce(red, bolt) AS "column", CASE WHEN red IS NULL THEN 'name' ELSE 'bolt_id' END AS match_on, CASE WHEN red IS NULL THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence FROM f WHERE bolt IS NOT NULL
          UNION ALL SELECT source, 'Ring', own, 'ring', CASE WHEN small IS NULL THEN 'INFERRED' ELSE 'EXTRACTED' END FROM f WHERE own IS NOT NULL UNION ALL SELECT source, 'Other', other, 'other', 'INFERRED' FROM o""")
def e1_heuristic_mapping(g: Graph) -> DataFrame:
    """Each brand a source whose columns are its parts' names."""
    named = g.table("part").select(F.col("p_brand").alias("source"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("column")).distinct()
    return mapping.heuristic(named.withColumn("place", F.col("column")), HINTS)


@query("""WITH c AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 11 <> 0) SELECT c_custkey AS id, 'entities: must be a list' AS problem FROM customer WHERE c_custkey % 11 = 0
          UNION ALL SELECT id, 'entities/0: label is required' FROM c WHERE id % 3 = 0 UNION ALL SELECT id, 'entities/1: column is required' FROM c WHERE id % 4 = 0 UNION ALL SELECT id, 'entities/1: unknown confidence ' || name FROM c WHERE id % 5 = 0
          UNION ALL SELECT c_custkey, 'relationships/0: not an endpoint: ' || c_name || '[x]' FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'relationships/0: not an endpoint: ' FROM customer WHERE c_custkey % 2 = 0""")
def e3_mapping_problems(g: Graph) -> DataFrame:
    """A mapping document a customer, sound unless its key says otherwise."""
    n, name = F.col("c_custkey"), F.col("c_name")
    every = lambda k, bad, good: F.when(n % k == 0, bad).otherwise(good)
    none = F.lit(None).cast("string")
    first = F.struct(every(3, none, F.col("c_mktsegment")).alias("label"), name.alias("column"))
    second = F.struct(name.alias("label"), every(4, F.lit(""), F.col("c_mktsegment")).alias("column"), every(5, name, F.lit("INFERRED")).alias("confidence"))
    ends = F.struct(every(7, F.concat(name, F.lit("[x]")), F.concat(F.lit("Taxon(id=row."), F.col("c_mktsegment"), F.lit(")"))).alias("from"), every(2, none, F.lit("Gene(symbol=row.gene name)")).alias("to"))
    listed = F.concat(F.lit("["), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]"))
    document = F.concat(F.lit('{"entities":'), every(11, F.lit('"none"'), listed), F.lit(',"relationships":['), F.to_json(ends), F.lit("]}"))
    return mapping.problems(g.table("customer").select(n.alias("id"), document.alias("mapping")))


@query("""SELECT prefix, count(*) AS n, CASE prefix WHEN 'chembi' THEN 'chebi' WHEN 'mond0' THEN 'mondo' WHEN 'hgcn' THEN 'hgnc' END AS closest
          FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'chembi' WHEN '2-HIGH' THEN 'mond0' WHEN '3-MEDIUM' THEN 'hgcn' WHEN '5-LOW' THEN 'zzz' END AS prefix FROM orders) WHERE prefix IS NOT NULL GROUP BY 1""")
def e4_prefixes(g: Graph) -> DataFrame:
    """Orders as identifiers, some with a prefix that is misspelt or unknown."""
    told = F.col("o_orderpriority")
    prefix = F.when(told == "1-URGENT", "CHEMBI").when(told == "2-HIGH", "mond0").when(told == "3-MEDIUM", "HGCN").when(told == "5-LOW", "zzz").otherwise("ChEBI")
    ids = g.table("orders").select(F.concat(prefix, F.lit(":"), F.col("o_orderkey").cast("string")).alias("id"))
    return mapping.unknown_prefixes(ids, g.spark.createDataFrame([("CHEBI",), ("MONDO",), ("HGNC",)], "prefix string"))


@query("SELECT label, id FROM nodes WHERE org = 'ASIA' OR org IN ('EUROPE')")
def e10_resolver_index(g: Graph) -> DataFrame:
    """Every node of every label that the caller may see, a row each."""
    return g.nodes.filter(g.scope.node()).select("label", "id")


@query("SELECT p_partkey, p_type AS label, 'f' || p_size AS field, p_name AS \"column\" FROM part WHERE p_partkey % 4 <> 0")
def e15_endpoint(g: Graph) -> DataFrame:
    """Endpoint expressions composed from parts; every fourth one has the wrong brackets and gives no row."""
    left, right = F.when(F.col("p_partkey") % 4 == 0, "[").otherwise(" ( "), F.when(F.col("p_partkey") % 4 == 0, "]").otherwise(" ) ")
    expression = F.concat(F.lit(" "), "p_type", left, F.lit("f"), F.col("p_size").cast("string"), F.lit(" = row."), "p_name", right)
    return g.table("part").select("p_partkey", mapping.endpoint(expression).alias("e")).filter("e IS NOT NULL").select("p_partkey", "e.*")


@query("""WITH p AS (SELECT DISTINCT 'label' AS kind, p_brand AS a, p_type AS b, 1 AS p FROM part WHERE p_size < 30 UNION ALL SELECT DISTINCT 'relation', 'S:' || l_suppkey, 'C:' || l_partkey, 1 FROM lineitem WHERE l_returnflag = 'A'),
          g AS (SELECT DISTINCT 'label' AS kind, p_brand AS a, p_type AS b, 1 AS g FROM part WHERE p_size > 20 UNION ALL SELECT DISTINCT 'relation', 'S:' || l_suppkey, 'C:' || l_partkey, 1 FROM lineitem WHERE l_quantity > 25),
          n AS (SELECT kind, count(p) AS p, count(g) AS g, count(p + g) AS h FROM p FULL JOIN g USING (kind, a, b) GROUP BY 1)
          SELECT kind, round(h * 1.0 / p, 6) AS precision_, round(h * 1.0 / g, 6) AS recall, round(2.0 * h / (p + g), 6) AS f1 FROM n""")
def e21_mapping_scores(g: Graph) -> DataFrame:
    """Labels of columns and signatures of relations, predicted ones against gold ones."""
    part, line = g.table("part"), g.table("lineitem")
    label = lambda rows: rows.select(F.lit("label").alias("kind"), F.col("p_brand").alias("a"), F.col("p_type").alias("b"))
    relation = lambda rows: rows.select(F.lit("relation").alias("kind"), F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("C:"), F.col("l_partkey").cast("string")).alias("b"))
    predicted = label(part.filter("p_size < 30")).unionByName(relation(line.filter("l_returnflag = 'A'")))
    gold = label(part.filter("p_size > 20")).unionByName(relation(line.filter("l_quantity > 25")))
    return mapping.scores(predicted, gold, "kind").select("kind", *(F.round(c, 6).alias(c) for c in ("precision_", "recall", "f1")))


@query(CHAIN + " SELECT chain, max(seq) AS length, arg_max(digest, seq) AS head FROM c GROUP BY 1")
def t10_chain_head(g: Graph) -> DataFrame:
    """Length and last digest of each chain: what shows a truncated tail."""
    return chains(g).groupBy("chain").agg(F.max("seq").alias("length"), F.max_by("digest", "seq").alias("head"))


@query("""WITH RECURSIVE n AS (SELECT r_regionkey AS id, NULL AS up, 'superkingdom' AS rank, CASE r_regionkey WHEN 1 THEN 'Bacteria' WHEN 3 THEN 'Fungi' ELSE r_name END AS name FROM region
              UNION ALL SELECT n_nationkey + 100, n_regionkey, 'phylum', n_name FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, 'genus', c_name FROM customer),
          w AS (SELECT id, name AS kingdom, CAST(NULL AS VARCHAR) AS phylum FROM n WHERE up IS NULL AND id IN (1, 3) UNION ALL SELECT n.id, w.kingdom, coalesce(w.phylum, n.name) FROM w JOIN n ON n.up = w.id)
          SELECT n.id AS tax_id, n.up AS parent_id, n.rank, n.name, w.kingdom, CASE WHEN n.rank <> 'superkingdom' THEN w.phylum END AS phylum, CASE WHEN n.rank = 'genus' THEN n.name END AS genus FROM w JOIN n USING (id)""")
def i1_taxonomy(g: Graph) -> DataFrame:
    """Taxa below the microbiome's groups, found by scientific name, with the names above them."""
    tax = lambda frame, id_, up, rank, name: frame.select(id_.cast("long").alias("tax_id"), up.cast("long").alias("parent_id"), F.lit(rank).alias("rank"), name.alias("name"))
    none, key = F.lit(None), F.col("r_regionkey")
    rows = tax(g.table("region"), key, none, "superkingdom", F.when(key == 1, "Bacteria").when(key == 3, "Fungi").otherwise(F.col("r_name")))
    rows = rows.unionAll(tax(g.table("nation"), F.col("n_nationkey") + 100, F.col("n_regionkey"), "phylum", F.col("n_name")))
    rows = rows.unionAll(tax(g.table("customer"), F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, "genus", F.col("c_name")))
    names = rows.select("tax_id", "name", F.lit("scientific name").alias("name_class")).unionAll(rows.select("tax_id", F.lit("Viruses"), F.lit("synonym")))
    found = loaders.taxa(rows.drop("name"), names)
    return found.select("tax_id", "parent_id", "rank", "name", "kingdom", "phylum", "genus")


@query("SELECT l_suppkey AS taxon_id, l_returnflag AS phenotype, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, count(v) AS n FROM (SELECT l_suppkey, l_returnflag, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS v FROM lineitem) GROUP BY 1, 2")
def i5_abundances(g: Graph) -> DataFrame:
    value = F.when(F.col("l_linenumber") % 3 == 0, "NA").otherwise(F.col("l_quantity").cast("string"))
    rows = g.table("lineitem").select(F.col("l_suppkey").alias("taxon_id"), F.col("l_returnflag").alias("phenotype"), value.alias("abundance"))
    return loaders.abundances(rows).select("taxon_id", "phenotype", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'ring')")
def i9_keyword_pathways(g: Graph) -> DataFrame:
    rows = g.table("part").select("p_partkey", F.col("p_name").alias("name"))
    return loaders.keyword_pathways(rows, ["Bolt", "RING"]).select("p_partkey", F.col("name").alias("p_name"))


@query("SELECT compound_id, row FROM (SELECT l_partkey AS compound_id, l_orderkey * 100000 + l_linenumber * 1000 + l_suppkey AS row, l_returnflag AS flag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 100000 + l_linenumber * 1000 + l_suppkey) AS k FROM lineitem) WHERE k <= 20 AND flag = 'A'")
def i11_assays(g: Graph) -> DataFrame:
    row = F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 1000 + F.col("l_suppkey")
    rows = g.table("lineitem").select(F.col("l_partkey").alias("compound_id"), row.alias("row"), F.when(F.col("l_returnflag") == "A", "Active").otherwise("Inactive").alias("activity"))
    return loaders.assays(rows).select("compound_id", "row")


@query("SELECT lower(replace(c_mktsegment || ' ' || replace(c_name, '#', ' '), '-', ' ')) AS disease, count(*) AS papers FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def i12_subject_headings(g: Graph) -> DataFrame:
    """Headings become diseases by the normaliser: an order is a paper, its customer the heading."""
    headings = g.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit(" "), "c_mktsegment", F.lit("-"), F.replace("c_name", F.lit("#"), F.lit("  "))).alias("heading"))
    counted = g.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("papers"))  # few rows are left to meet the headings
    return counted.join(headings, "o_custkey").groupBy(normal_disease(F.col("heading")).alias("disease")).agg(F.sum("papers").alias("papers"))


@query("SELECT o_orderkey AS sample, l_partkey AS measured, CAST(l_linenumber AS BIGINT) AS place FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def i15_nested_measurements(g: Graph) -> DataFrame:
    """All orders, a study for each customer, whose orders bound its nested arrays."""
    lines = g.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("measured"), F.col("l_linenumber").cast("long").alias("place"))).alias("measurements"))
    samples = g.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("study")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("sample"), "measurements")).alias("samples"))
    return samples.select(F.explode("samples").alias("s")).select("s.sample", F.inline("s.measurements"))
