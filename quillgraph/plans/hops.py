"""Joins along edges, aggregates and set comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import joined_set
from quillgraph.operators.hops import co_occurring, majority, shared_by_all, undirected
from quillgraph.operators.mentions import mentions
from quillgraph.plans.reads import s1, s2
from quillgraph.plans.registry import query
from quillgraph.plans.views import Graph


@query(f"""SELECT d.disease_id, d.name, a.direction, a.n_studies, a.effect_size, string_agg(DISTINCT a.source, '|' ORDER BY a.source) AS sources FROM assoc a JOIN disease d USING (disease_id)
           WHERE a.taxon_id = 'S:7' AND {s2('a')} AND a.direction = 'enriched' GROUP BY 1, 2, 3, 4, 5 ORDER BY a.effect_size DESC NULLS FIRST, d.disease_id LIMIT 100""")
def j1_taxon_diseases(g: Graph) -> DataFrame:
    edges = g.assoc.filter((F.col("taxon_id") == "S:7") & g.scope.edge() & (F.col("direction") == "enriched")).drop("org")
    rows = edges.join(g.disease.select("disease_id", "name"), "disease_id")
    grouped = rows.groupBy("disease_id", "name", "direction", "n_studies", "effect_size").agg(joined_set("source").alias("sources"))
    return grouped.orderBy(F.col("effect_size").desc_nulls_first(), "disease_id").limit(100)


@query(f"SELECT c.compound_id, c.name, c.category FROM produces p JOIN compound c USING (compound_id) WHERE p.taxon_id = 'S:7' AND {s1('c')} AND c.category = 'PROMO' ORDER BY c.name, c.compound_id LIMIT 100")
def j2_taxon_metabolites(g: Graph) -> DataFrame:
    near = g.produces.filter(F.col("taxon_id") == "S:7").select("compound_id")
    return near.join(g.compound.filter(g.scope.node() & (F.col("category") == "PROMO")), "compound_id").select("compound_id", "name", "category").orderBy("name", "compound_id").limit(100)


@query("SELECT taxon_id, name, rank FROM taxon WHERE parent_id = 'R:2' AND rank = 'genus' ORDER BY name, taxon_id")
def j3_taxon_children(g: Graph) -> DataFrame:
    return g.taxon.filter("parent_id = 'R:2' AND rank = 'genus'").select("taxon_id", "name", "rank").orderBy("name", "taxon_id")


@query(f"""SELECT t.taxon_id, t.name, a.direction, a.n_studies, a.effect_size FROM assoc a JOIN taxon t USING (taxon_id) WHERE a.disease_id = 'D:7' AND {s2('a')} AND {s1('t')} AND a.n_studies >= 1
           ORDER BY a.n_studies DESC, t.name, t.taxon_id LIMIT 20 OFFSET 3""")
def j4_disease_taxa(g: Graph) -> DataFrame:
    edges = g.assoc.filter((F.col("disease_id") == "D:7") & g.scope.edge() & (F.col("n_studies") >= 1)).drop("org")
    rows = edges.join(g.taxon.filter(g.scope.node()).select("taxon_id", "name"), "taxon_id")
    return rows.select("taxon_id", "name", "direction", "n_studies", "effect_size").orderBy(F.col("n_studies").desc(), "name", "taxon_id").offset(3).limit(20)


@query("""SELECT d.disease_id, d.name, count(DISTINCT b.taxon_id) AS shared FROM assoc a JOIN assoc b ON a.taxon_id = b.taxon_id AND a.disease_id <> b.disease_id JOIN disease d ON d.disease_id = b.disease_id
          WHERE a.disease_id = 'D:7' GROUP BY 1, 2 HAVING count(DISTINCT b.taxon_id) >= 5 ORDER BY shared DESC, d.name, d.disease_id LIMIT 200""")
def j5_related_diseases(g: Graph) -> DataFrame:
    """Diseases that share taxa with one: the flagship co-occurrence query."""
    shared = co_occurring(g.assoc.select("taxon_id", "disease_id"), "taxon_id", "disease_id", "D:7", 5)
    return shared.join(g.disease.select("disease_id", "name"), "disease_id").select("disease_id", "name", "shared").orderBy(F.col("shared").desc(), "name", "disease_id").limit(200)


@query("""SELECT compound_id, producers, CASE WHEN e > d THEN 'enriched' WHEN d > e THEN 'depleted' ELSE 'mixed' END AS direction FROM (
            SELECT p.compound_id, count(DISTINCT t.name || '/' || a.direction) AS producers, count(DISTINCT CASE WHEN a.direction = 'enriched' THEN t.name END) AS e, count(DISTINCT CASE WHEN a.direction = 'depleted' THEN t.name END) AS d
            FROM assoc a JOIN taxon t USING (taxon_id) JOIN produces p USING (taxon_id) WHERE a.disease_id = 'D:7' GROUP BY 1) WHERE producers >= 3 ORDER BY producers DESC, compound_id LIMIT 100""")
def j6_disease_metabolites(g: Graph) -> DataFrame:
    """Pairs of producer and direction are counted, so a taxon with two directions counts twice."""
    near = g.assoc.filter("disease_id = 'D:7'").select("taxon_id", "direction").join(g.taxon.select("taxon_id", "name"), "taxon_id")
    pairs = F.collect_set(F.struct("name", "direction"))
    rows = near.join(g.produces.select("taxon_id", "compound_id"), "taxon_id").groupBy("compound_id").agg(pairs.alias("pairs"))
    n = lambda d: F.size(F.filter("pairs", lambda x: x["direction"] == d))
    return rows.select("compound_id", F.size("pairs").cast("long").alias("producers"), majority(n("enriched"), n("depleted")).alias("direction")).filter("producers >= 3").orderBy(F.col("producers").desc(), "compound_id").limit(100)


@query("SELECT t.taxon_id, t.name, t.rank FROM produces p JOIN taxon t USING (taxon_id) WHERE p.compound_id = 'C:11' AND t.rank = 'species' ORDER BY t.name, t.taxon_id LIMIT 10 OFFSET 2")
def j7_metabolite_producers(g: Graph) -> DataFrame:
    near = g.produces.filter("compound_id = 'C:11'").select("taxon_id")
    return near.join(g.taxon.filter("rank = 'species'"), "taxon_id").select("taxon_id", "name", "rank").orderBy("name", "taxon_id").offset(2).limit(10)


@query("""SELECT a.disease_id, count(DISTINCT a.taxon_id || '/' || a.direction) AS producers, count(DISTINCT CASE WHEN a.direction = 'enriched' THEN a.taxon_id END) AS enriched, count(DISTINCT CASE WHEN a.direction = 'depleted' THEN a.taxon_id END) AS depleted
          FROM produces p JOIN assoc a USING (taxon_id) WHERE p.compound_id = 'C:11' GROUP BY 1 HAVING count(DISTINCT a.taxon_id || '/' || a.direction) >= 2 ORDER BY producers DESC, a.disease_id LIMIT 150""")
def j8_metabolite_diseases(g: Graph) -> DataFrame:
    rows = g.produces.filter("compound_id = 'C:11'").select("taxon_id").join(g.assoc.select("taxon_id", "disease_id", "direction"), "taxon_id")
    counted = rows.groupBy("disease_id").agg(F.collect_set(F.struct("taxon_id", "direction")).alias("pairs"))
    n = lambda d: F.size(F.filter("pairs", lambda x: x["direction"] == d)).cast("long")
    out = counted.select("disease_id", F.size("pairs").cast("long").alias("producers"), n("enriched").alias("enriched"), n("depleted").alias("depleted"))
    return out.filter("producers >= 2").orderBy(F.col("producers").desc(), "disease_id").limit(150)


@query("SELECT p.pathway_id, p.name FROM participates x JOIN pathway p USING (pathway_id) WHERE x.compound_id = 'C:11' ORDER BY p.name, p.pathway_id LIMIT 10 OFFSET 1")
def j9_metabolite_pathways(g: Graph) -> DataFrame:
    return g.participates.filter("compound_id = 'C:11'").join(g.pathway, "pathway_id").select("pathway_id", "name").orderBy("name", "pathway_id").offset(1).limit(10)


@query("SELECT c.compound_id, c.name FROM participates x JOIN compound c USING (compound_id) WHERE x.pathway_id = 'P:3' ORDER BY c.name, c.compound_id LIMIT 100")
def j10_pathway_metabolites(g: Graph) -> DataFrame:
    return g.participates.filter("pathway_id = 'P:3'").join(g.compound, "compound_id").select("compound_id", "name").orderBy("name", "compound_id").limit(100)


@query("SELECT gene FROM gene_pathway WHERE pathway_id = 'P:3' ORDER BY gene")
def j10_pathway_genes(g: Graph) -> DataFrame:
    return g.gene_pathway.filter("pathway_id = 'P:3'").select("gene").orderBy("gene")


@query("SELECT DISTINCT t.taxon_id, t.name, 'metabolite' AS via FROM participates x JOIN produces p USING (compound_id) JOIN taxon t USING (taxon_id) WHERE x.pathway_id = 'P:3'")
def j11_pathway_taxa(g: Graph) -> DataFrame:
    taxa = g.participates.filter("pathway_id = 'P:3'").join(g.produces.select("taxon_id", "compound_id"), "compound_id").select("taxon_id").distinct()
    return taxa.join(g.taxon, "taxon_id").select("taxon_id", "name", F.array_join(F.array(F.lit("metabolite")), "|").alias("via"))


@query("""SELECT other, type, count(*) AS n FROM (SELECT dst AS other, type FROM edges WHERE src = 'G:7' UNION ALL SELECT src, type FROM edges WHERE dst = 'G:7' UNION ALL SELECT dst, type FROM edges WHERE src = 'S:3' UNION ALL SELECT src, type FROM edges WHERE dst = 'S:3')
          WHERE other LIKE 'G:%' OR other LIKE 'S:%' OR other LIKE 'N:%' GROUP BY 1, 2""")
def j12_any_edge_neighbours(g: Graph) -> DataFrame:
    """Edges of any type in either direction."""
    both = undirected(g.edges).filter(F.col("src").isin("G:7", "S:3"))
    return both.filter(F.col("dst").rlike("^[GSN]:")).groupBy(F.col("dst").alias("other"), "type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a.disease_id, count(DISTINCT e.taxon_id) AS taxa, string_agg(DISTINCT e.taxon_id || '/' || a.direction, '|' ORDER BY e.taxon_id || '/' || a.direction) AS via FROM effective e JOIN assoc a USING (taxon_id)
          WHERE e.drug_id = (SELECT min(drug_id) FROM drug) GROUP BY 1 ORDER BY taxa DESC, a.disease_id LIMIT 80""")
def j13_drug_diseases(g: Graph) -> DataFrame:
    one = g.drug.agg(F.min("drug_id").alias("drug_id"))
    rows = g.effective.join(F.broadcast(one), "drug_id", "left_semi").select("taxon_id").join(g.assoc, "taxon_id")  # one row
    via = joined_set(F.concat_ws("/", "taxon_id", "direction"))
    return rows.groupBy("disease_id").agg(F.countDistinct("taxon_id").alias("taxa"), via.alias("via")).orderBy(F.col("taxa").desc(), "disease_id").limit(80)


@query("SELECT pathway_id FROM gene_pathway WHERE gene = 'Brand#7' ORDER BY pathway_id LIMIT 10 OFFSET 2")
def j14_gene_pathways(g: Graph) -> DataFrame:
    return g.gene_pathway.filter("gene = 'Brand#7'").select("pathway_id").orderBy("pathway_id").offset(2).limit(10)


@query("SELECT drug_id, protein_id FROM targets WHERE protein_id IN ('U:21', 'U:3', 'U:30') ORDER BY 1, 2")
def j14_protein_drugs(g: Graph) -> DataFrame:
    return g.targets.filter(F.col("protein_id").isin("U:21", "U:3", "U:30")).orderBy("drug_id", "protein_id")


@query("SELECT p.paper_id, p.year FROM mention m JOIN paper p USING (paper_id) WHERE m.entity_id = 'S:7' ORDER BY p.year DESC, p.paper_id")
def j15_papers_by_taxon(g: Graph) -> DataFrame:
    return g.mention.filter("entity_id = 'S:7'").join(g.paper.select("paper_id", "year"), "paper_id").select("paper_id", "year").orderBy(F.col("year").desc(), "paper_id")


@query("SELECT p.paper_id, p.year FROM mention m JOIN paper p USING (paper_id) WHERE m.entity_id = 'D:9' ORDER BY p.year DESC, p.paper_id")
def j15_papers_by_disease(g: Graph) -> DataFrame:
    return g.mention.filter("entity_id = 'D:9'").join(g.paper.select("paper_id", "year"), "paper_id").select("paper_id", "year").orderBy(F.col("year").desc(), "paper_id")


@query("""SELECT a.taxon_id, a.effect_size AS potential, count(DISTINCT c.compound_id) AS n_scfa FROM assoc a JOIN taxon t USING (taxon_id) LEFT JOIN (SELECT p.taxon_id, c.compound_id FROM produces p JOIN compound c USING (compound_id) WHERE c.is_scfa) c USING (taxon_id)
          WHERE a.disease_id = 'D:9' AND a.direction = 'depleted' AND t.common_name IS NOT NULL GROUP BY 1, 2 ORDER BY potential DESC NULLS FIRST, n_scfa DESC, a.taxon_id LIMIT 50""")
def j16_probiotic_candidates(g: Graph) -> DataFrame:
    taxa = g.assoc.filter("disease_id = 'D:9' AND direction = 'depleted'").join(g.taxon.filter("common_name IS NOT NULL").select("taxon_id"), "taxon_id").select("taxon_id", F.col("effect_size").alias("potential"))
    scfa = g.produces.join(g.compound.filter("is_scfa").select("compound_id"), "compound_id").groupBy("taxon_id").agg(F.countDistinct("compound_id").alias("n_scfa"))
    out = taxa.join(scfa, "taxon_id", "left").select("taxon_id", "potential", F.coalesce("n_scfa", F.lit(0)).cast("long").alias("n_scfa"))
    return out.orderBy(F.col("potential").desc_nulls_first(), F.col("n_scfa").desc(), "taxon_id").limit(50)


@query("SELECT p.taxon_id, count(DISTINCT c.compound_id) AS n_scfa, string_agg(DISTINCT c.name, '|' ORDER BY c.name) AS names FROM produces p JOIN compound c USING (compound_id) WHERE c.is_scfa GROUP BY 1 ORDER BY n_scfa DESC, p.taxon_id LIMIT 50")
def j17_scfa_producers(g: Graph) -> DataFrame:
    rows = g.produces.select("taxon_id", "compound_id").join(g.compound.filter("is_scfa").select("compound_id", "name"), "compound_id")
    return rows.groupBy("taxon_id").agg(F.countDistinct("compound_id").alias("n_scfa"), joined_set("name").alias("names")).orderBy(F.col("n_scfa").desc(), "taxon_id").limit(50)


@query("SELECT disease_id, name FROM disease d WHERE EXISTS (SELECT 1 FROM assoc a WHERE a.disease_id = d.disease_id AND a.direction = 'depleted' AND a.n_studies >= 3)")
def j18_semi_join(g: Graph) -> DataFrame:
    return g.disease.join(g.assoc.filter("direction = 'depleted' AND n_studies >= 3"), "disease_id", "left_semi").select("disease_id", "name")


@query("SELECT compound_id FROM compound c WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.compound_id = c.compound_id AND l.disease_id IN ('D:1', 'D:2', 'D:3', 'D:4', 'D:5'))")
def j19_anti_join(g: Graph) -> DataFrame:
    return g.compound.join(g.linked.filter(F.col("disease_id").isin("D:1", "D:2", "D:3", "D:4", "D:5")), "compound_id", "left_anti").select("compound_id")


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part) SELECT w.word, count(*) AS papers FROM documents d JOIN w ON contains(lower(d.text), w.word) WHERE length(w.word) > 3 GROUP BY 1""")
def j20_text_contains(g: Graph) -> DataFrame:
    """How many texts hold each word of a part's name, as a substring."""
    names = g.table("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("name")).distinct().withColumn("name_id", F.col("name"))
    texts = g.table("documents").select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text"))
    return mentions(texts, names).groupBy(F.col("name_id").alias("word")).agg(F.count(F.lit(1)).alias("papers"))


@query(r"""WITH b AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark),
          n AS (SELECT item_id * 10 AS name_id, w[2] AS name FROM b UNION ALL SELECT item_id * 10 + 1, array_to_string(w[1:2], ' ') FROM b UNION ALL SELECT item_id * 10 + 2, substr(array_to_string(w[3:7], ' '), 2) FROM b
                UNION ALL SELECT p_partkey * 10 + 3, lower(p_name) FROM part)
          SELECT DISTINCT 'PMID:' || d.doc_id AS paper_id, n.name_id FROM documents d JOIN n ON contains(lower(d.text), n.name) WHERE length(n.name) > 3""")
def j20_name_mentions(g: Graph) -> DataFrame:
    """MENTIONED_IN by text: names of one, two and several words, some cut within a word, against every text."""
    words = g.table("benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w"))
    cuts = [F.get("w", F.lit(1)), F.array_join(F.slice("w", 1, 2), " "), F.expr("substring(array_join(slice(w, 3, 5), ' '), 2)")]
    names = words.select(F.posexplode(F.array(*cuts)).alias("k", "name"), "item_id").select((F.col("item_id") * 10 + F.col("k")).alias("name_id"), "name")
    names = names.unionByName(g.table("part").select((F.col("p_partkey") * 10 + 3).alias("name_id"), F.lower("p_name").alias("name")))
    texts = g.table("documents").select(F.concat(F.lit("PMID:"), F.col("doc_id").cast("string")).alias("text_id"), F.lower("text").alias("text"))
    return mentions(texts, names).select(F.col("text_id").alias("paper_id"), "name_id")


@query("""SELECT a.p_partkey AS a_id, b.p_partkey AS b_id FROM part a JOIN part b ON (a.p_name = b.p_name AND a.p_brand = b.p_brand) OR a.p_retailprice = b.p_retailprice WHERE a.p_partkey < b.p_partkey""")
def j21_disjunctive_join(g: Graph) -> DataFrame:
    """Either of two keys: an equi-join on each, the second one without the pairs of the first, so that nothing is made distinct."""
    a = g.table("part").select(F.col("p_partkey").alias("a_id"), "p_name", "p_brand", "p_retailprice")
    b = a.select(F.col("a_id").alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in a.columns[1:]))
    named = (F.col("p_name") == F.col("b_p_name")) & (F.col("p_brand") == F.col("b_p_brand"))
    priced = (F.col("p_retailprice") == F.col("b_p_retailprice")) & ~F.coalesce(named, F.lit(False))
    later = F.col("a_id") < F.col("b_id")
    return a.join(b, named & later).unionAll(a.join(b, priced & later)).select("a_id", "b_id")


@query("""SELECT x.taxon_id, x.name, p.pattern, min(CASE WHEN x.name = p.pattern THEN 0 WHEN x.parent_id = p.parent THEN 1 ELSE 2 END) AS level FROM taxon x
          JOIN (SELECT name AS pattern, taxon_id AS parent FROM taxon WHERE rank = 'genus' AND taxon_id IN ('N:1', 'N:2', 'N:7')) p ON x.name = p.pattern OR (x.parent_id = p.parent AND x.rank = 'species') OR (starts_with(x.name, p.pattern || '0') AND x.rank <> 'species') GROUP BY 1, 2, 3""")
def j22_rank_aware_patterns(g: Graph) -> DataFrame:
    """Exact name, species of a genus, or name prefix: three keyed joins, the best level of each pair."""
    patterns = g.taxon.filter(F.col("taxon_id").isin("N:1", "N:2", "N:7") & (F.col("rank") == "genus")).select(F.col("name").alias("pattern"), F.col("taxon_id").alias("parent"))
    t = g.taxon.select("taxon_id", "name", "rank", "parent_id")
    exact = t.join(patterns, t["name"] == patterns["pattern"]).withColumn("level", F.lit(0))
    species = t.filter("rank = 'species'").join(patterns, t["parent_id"] == patterns["parent"]).withColumn("level", F.lit(1))
    prefix = t.filter("rank <> 'species'").withColumn("stem", F.expr("substr(name, 1, length(name) - 1)")).join(patterns, F.col("stem") == F.col("pattern")).filter("name = pattern || '0'").drop("stem").withColumn("level", F.lit(2))
    out = exact.unionByName(species).unionByName(prefix)
    return out.groupBy("taxon_id", "name", "pattern").agg(F.min("level").alias("level"))


@query("SELECT direction, count(*) AS n, count(DISTINCT taxon_id) AS taxa, count(DISTINCT disease_id) AS diseases FROM assoc GROUP BY 1")
def a1_counts(g: Graph) -> DataFrame:
    return g.assoc.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("taxon_id").alias("taxa"), F.countDistinct("disease_id").alias("diseases"))


@query("SELECT disease_id, string_agg(DISTINCT direction, '|' ORDER BY direction) AS directions, string_agg(DISTINCT source || ':' || direction, '|' ORDER BY source || ':' || direction) AS pairs FROM assoc GROUP BY 1")
def a2_collect(g: Graph) -> DataFrame:
    return g.assoc.groupBy("disease_id").agg(joined_set("direction").alias("directions"), joined_set(F.concat_ws(":", "source", "direction")).alias("pairs"))


@query("SELECT disease_id, count(CASE WHEN direction = 'enriched' THEN 1 END) AS enriched, count(CASE WHEN direction = 'depleted' AND effect_size > 20 THEN 1 END) AS strong FROM assoc GROUP BY 1")
def a3_conditional(g: Graph) -> DataFrame:
    return g.assoc.groupBy("disease_id").agg(F.count_if(F.col("direction") == "enriched").alias("enriched"), F.count_if((F.col("direction") == "depleted") & (F.col("effect_size") > 20)).alias("strong"))


@query("SELECT taxon_id, sum(n_studies)::BIGINT AS studies FROM assoc GROUP BY 1 HAVING sum(n_studies) >= 500".replace("sum(n_studies)::BIGINT", "CAST(sum(n_studies) AS BIGINT)"))
def a4_having(g: Graph) -> DataFrame:
    return g.assoc.groupBy("taxon_id").agg(F.sum("n_studies").alias("studies")).filter("studies >= 500")


@query("SELECT disease_id, min(effect_size) AS least, min(taxon_id) AS first_taxon FROM assoc GROUP BY 1")
def a5_min_head(g: Graph) -> DataFrame:
    return g.assoc.groupBy("disease_id").agg(F.min("effect_size").alias("least"), F.min("taxon_id").alias("first_taxon"))


@query("SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY 2")
def a6_graph_stats(g: Graph) -> DataFrame:
    nodes = g.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    return nodes.unionAll(g.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge"), "type", "n"))


@query("SELECT (SELECT count(*) FROM customer) AS patients, (SELECT count(*) FROM orders) AS samples, (SELECT count(*) FROM taxon) AS taxa, (SELECT count(*) FROM paper) AS papers")
def a7_org_stats(g: Graph) -> DataFrame:
    """One row of four counts; none if any of them is zero."""
    frames = [("patients", g.table("customer")), ("samples", g.table("orders")), ("taxa", g.taxon), ("papers", g.paper)]
    rows = None
    for name, f in frames:
        one = f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionAll(one)
    return rows.groupBy().pivot("name", [n for n, _ in frames]).agg(F.first("n")).filter("patients > 0 AND samples > 0 AND taxa > 0 AND papers > 0")


@query("SELECT source, count(*) AS n, count(DISTINCT taxon_id) AS taxa FROM (SELECT unnest([source, 'merged']) AS source, taxon_id FROM assoc) GROUP BY 1")
def a8_source_inventory(g: Graph) -> DataFrame:
    sources = F.array(F.col("source"), F.lit("merged"))
    return g.assoc.select(F.explode(sources).alias("source"), "taxon_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("taxon_id").alias("taxa"))


@query("SELECT type, count(*) AS n FROM (SELECT type FROM edges WHERE src = 'S:7' UNION ALL SELECT type FROM edges WHERE dst = 'S:7') GROUP BY 1")
def a9_entity_provenance(g: Graph) -> DataFrame:
    return undirected(g.edges).filter("src = 'S:7'").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(*) AS total, count(org) AS with_org, round(100.0 * count(org) / count(*), 1) AS pct FROM nodes GROUP BY 1")
def a10_coverage(g: Graph) -> DataFrame:
    total, known = F.count(F.lit(1)), F.count("org")
    return g.nodes.groupBy("label").agg(total.alias("total"), known.alias("with_org"), F.round(known * 100.0 / total, 1).alias("pct"))


@query("SELECT type, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, type")
def a11_schema_histogram(g: Graph) -> DataFrame:
    return g.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "type")


@query("SELECT kingdom, rank, count(*) AS n FROM taxon GROUP BY CUBE (kingdom, rank)")
def a12_cube(g: Graph) -> DataFrame:
    return g.taxon.cube("kingdom", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT taxon_id, disease_id, n_studies FROM (SELECT *, row_number() OVER (PARTITION BY taxon_id ORDER BY n_studies DESC, effect_size DESC NULLS LAST, disease_id) AS k FROM assoc) WHERE k <= 3")
def w0_first_per_group(g: Graph) -> DataFrame:
    best = Window.partitionBy("taxon_id").orderBy(F.col("n_studies").desc(), F.col("effect_size").desc_nulls_last(), "disease_id")
    return g.assoc.withColumn("k", F.row_number().over(best)).filter("k <= 3").select("taxon_id", "disease_id", "n_studies")


@query("SELECT compound_id, count(DISTINCT taxon_id) AS owners, count(DISTINCT taxon_id) = 3 AS in_all FROM produces WHERE taxon_id IN ('S:1', 'S:2', 'S:3') GROUP BY 1")
def u1_compare_taxa(g: Graph) -> DataFrame:
    return shared_by_all(g.produces, "compound_id", "taxon_id", ["S:1", "S:2", "S:3"])


@query("""SELECT taxon_id, direction, count(DISTINCT disease_id) AS owners, min(CASE WHEN n = 1 THEN disease_id END) AS unique_to FROM (SELECT taxon_id, direction, disease_id, count(*) OVER (PARTITION BY taxon_id, direction) AS n FROM assoc WHERE disease_id IN ('D:7', 'D:9', 'D:11') AND direction <> 'altered') GROUP BY 1, 2""")
def u2_compare_diseases(g: Graph) -> DataFrame:
    rows = g.assoc.filter(F.col("disease_id").isin("D:7", "D:9", "D:11") & (F.col("direction") != "altered"))
    grouped = rows.groupBy("taxon_id", "direction").agg(F.countDistinct("disease_id").alias("owners"), F.min("disease_id").alias("one"))
    return grouped.select("taxon_id", "direction", "owners", F.when(F.col("owners") == 1, F.col("one")).alias("unique_to"))


@query("SELECT taxon_id AS id FROM assoc WHERE disease_id = 'D:7' UNION SELECT taxon_id FROM produces WHERE compound_id = 'C:11'")
def u3_union_distinct(g: Graph) -> DataFrame:
    return g.assoc.filter("disease_id = 'D:7'").select(F.col("taxon_id").alias("id")).unionAll(g.produces.filter("compound_id = 'C:11'").select("taxon_id")).distinct()


@query("SELECT taxon_id AS id, 'assoc' AS origin FROM assoc WHERE disease_id = 'D:7' UNION ALL SELECT taxon_id, 'produces' FROM produces WHERE compound_id = 'C:11'")
def u4_union_all(g: Graph) -> DataFrame:
    return g.assoc.filter("disease_id = 'D:7'").select(F.col("taxon_id").alias("id"), F.lit("assoc").alias("origin")).unionAll(g.produces.filter("compound_id = 'C:11'").select("taxon_id", F.lit("produces")))


@query("""SELECT id, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (
          SELECT coalesce(a.taxon_id, b.taxon_id) AS id, a.name AS o, b.name AS n FROM (SELECT * FROM taxon WHERE ncbi_tax_id % 5 <> 0) a FULL JOIN (SELECT taxon_id, CASE WHEN ncbi_tax_id % 7 = 0 THEN upper(name) || '!' ELSE name END AS name FROM taxon WHERE ncbi_tax_id % 3 <> 0) b ON a.taxon_id = b.taxon_id) WHERE o IS DISTINCT FROM n""")
def u5_bundle_diff(g: Graph) -> DataFrame:
    from quillgraph.operators.upsert import snapshot_diff

    old = g.taxon.filter("ncbi_tax_id % 5 <> 0").select(F.col("taxon_id").alias("id"), "name")
    new = g.taxon.filter("ncbi_tax_id % 3 <> 0").select(F.col("taxon_id").alias("id"), F.when(F.col("ncbi_tax_id") % 7 == 0, F.concat(F.upper("name"), F.lit("!"))).otherwise(F.col("name")).alias("name"))
    return snapshot_diff(old, new, ["id"], ["name"])


@query("""WITH p AS (SELECT p_brand || '/' || p_name AS class, p_partkey % 2 AS k, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS t FROM part GROUP BY 1, 2)
          SELECT class, CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' WHEN a.t <> b.t THEN 'changed' ELSE 'same' END AS change FROM (SELECT * FROM p WHERE k = 0) a FULL JOIN (SELECT * FROM p WHERE k = 1) b USING (class)""")
def u6_template_diff(g: Graph) -> DataFrame:
    """Two templates whose classes are names within brands: the types of parts with even keys, and of those with odd ones."""
    types = lambda k, to: g.table("part").filter(F.col("p_partkey") % 2 == k).groupBy(F.concat_ws("/", "p_brand", "p_name").alias("class")).agg(joined_set("p_type").alias(to))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return types(0, "a").join(types(1, "b"), "class", "full").select("class", change.alias("change"))


@query("""SELECT o, round(CASE WHEN p = 0 THEN 1.0 ELSE tp * 1.0 / p END, 6) AS precision_, round(CASE WHEN g = 0 THEN 1.0 ELSE tp * 1.0 / g END, 6) AS recall FROM (SELECT taxon_id AS o, count(*) FILTER (pred AND gold) AS tp, count(*) FILTER (pred) AS p, count(*) FILTER (gold) AS g FROM (SELECT taxon_id, n_studies >= 2 AS pred, effect_size > 25 IS TRUE AS gold FROM assoc) GROUP BY 1)""".replace("effect_size > 25 IS TRUE", "coalesce(effect_size > 25, false)"))
def u7_precision_recall(g: Graph) -> DataFrame:
    pred, gold = F.col("n_studies") >= 2, F.coalesce(F.col("effect_size") > 25, F.lit(False))
    rows = g.assoc.groupBy(F.col("taxon_id").alias("o")).agg(F.count_if(pred & gold).alias("tp"), F.count_if(pred).alias("p"), F.count_if(gold).alias("g"))
    share = lambda n: F.round(F.when(F.col(n) == 0, 1.0).otherwise(F.col("tp") / F.col(n)), 6)
    return rows.select("o", share("p").alias("precision_"), share("g").alias("recall"))
