"""Resolution, mapping, routing, profiling and loader transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import ABBREVIATIONS, direction_of, disease_id, first_filled, normal_disease
from quillgraph.operators import resolve
from quillgraph.operators.fuzzy import fuzzy
from quillgraph.operators.profile import delimited, profile, typed_columns
from quillgraph.plans.curation import LINE_ORDER
from quillgraph.plans.registry import query
from quillgraph.plans.views import Graph

NORMAL = """trim(regexp_replace(replace(regexp_replace(coalesce(m.full_, squeezed), '[''’]', '', 'g'), '-', ' '), '\\s+', ' ', 'g'))"""
SHORT = "(VALUES " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in ABBREVIATIONS.items()) + ") m(short, full_)"
TERMS = "(SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'C:' || p_partkey WHEN 1 THEN 'C:9' || p_partkey WHEN 2 THEN upper(p_name) WHEN 3 THEN '' ELSE 'zz ' || p_name || ' qqqq' END AS term FROM part)"
NAMES = "(SELECT p_name AS name, 'C:' || min(p_partkey) AS id FROM part GROUP BY 1)"


def terms(g: Graph) -> DataFrame:
    n, name = F.col("p_partkey"), F.col("p_name")
    term = F.when(n % 5 == 0, F.concat(F.lit("C:"), n.cast("string"))).when(n % 5 == 1, F.concat(F.lit("C:9"), n.cast("string"))).when(n % 5 == 2, F.upper(name)).when(n % 5 == 3, "").otherwise(F.concat(F.lit("zz "), name, F.lit(" qqqq")))
    return g.table("part").select("p_partkey", term.alias("term"))


def name_nodes(g: Graph) -> DataFrame:
    return g.table("part").groupBy(F.col("p_name").alias("name")).agg(F.concat(F.lit("C:"), F.min("p_partkey").cast("string")).alias("id"))


@query(f"SELECT DISTINCT t.term, n.id, 1.0::DOUBLE AS score FROM {TERMS} t JOIN {NAMES} n ON t.term = n.id".replace("1.0::DOUBLE", "CAST(1.0 AS DOUBLE)"))
def e5_identifier_match(g: Graph) -> DataFrame:
    return terms(g).select("term").distinct().join(name_nodes(g), F.col("term") == F.col("id")).select("term", "id", F.lit(1.0).alias("score"))


@query(f"SELECT DISTINCT t.term, n.id FROM {TERMS} t JOIN {NAMES} n ON lower(t.term) = lower(n.name)")
def e6_exact_name_match(g: Graph) -> DataFrame:
    return terms(g).select("term").distinct().join(name_nodes(g), F.lower("term") == F.lower("name")).select("term", "id")


@query()
def e7_fuzzy_match(g: Graph) -> DataFrame:
    """Names with a doubled letter find their way back; the ratio is beyond SQL, so tests hold it to brute force."""
    asked = g.table("part").select(F.concat(F.col("p_name").substr(1, 3), F.col("p_name").substr(F.lit(3), F.length("p_name"))).alias("term")).distinct()
    return fuzzy(asked, name_nodes(g)).select("term", "id", F.round("score", 6).alias("score"))


@query(f"SELECT lower(p_type) AS term, min('C:' || p_partkey) AS first_id, count(*) AS n, CASE WHEN count(*) > 1 THEN 'AMBIGUOUS' ELSE 'INFERRED' END AS tier FROM part GROUP BY 1")
def e8_ambiguity(g: Graph) -> DataFrame:
    rows = g.table("part").groupBy(F.lower("p_type").alias("term")).agg(F.min(F.concat(F.lit("C:"), F.col("p_partkey").cast("string"))).alias("first_id"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("tier", F.when(F.col("n") > 1, "AMBIGUOUS").otherwise("INFERRED"))


BRANDED = "(SELECT 'C:' || p_partkey AS id, lower(p_name || ' ' || p_brand) AS name FROM part)"
ASKED = """(SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'C:' || p_partkey WHEN 1 THEN 'C:x' || p_partkey WHEN 2 THEN upper(p_name) || ' ' || p_brand WHEN 3 THEN '' WHEN 4 THEN substr(p_name, 1, 3) || substr(p_name, 3) || ' ' || p_brand ELSE '~~~~~~~~' || p_partkey END AS term FROM part)"""
#: Terms that are a name with one letter doubled: their best names are those a single letter away, and of these the longest.
MATCHED = f"""a AS {ASKED}, n AS (SELECT DISTINCT id, name FROM {BRANDED}), hit AS (SELECT term, id, CAST(1.0 AS DOUBLE) AS score, 'EXTRACTED' AS tier FROM a JOIN n ON term LIKE 'C:%' AND term = id
           UNION ALL SELECT term, id, 0.95, 'INFERRED' FROM a JOIN n ON NOT term LIKE 'C:%' AND lower(term) = name), fuzz AS (SELECT term, id, length(term) + length(name) AS s FROM a JOIN n ON NOT term LIKE 'C:%' AND abs(length(term) - length(name)) = 1 AND levenshtein(lower(term), name) = 1 WHERE term NOT IN (SELECT term FROM hit)),
           alike AS (SELECT * FROM hit UNION ALL SELECT term, id, (s - 1) * 1.0 / s, 'INFERRED' FROM fuzz f WHERE s = (SELECT max(s) FROM fuzz WHERE term = f.term)), best AS (SELECT term, min(id) AS id, max(score) AS score, min(tier) AS tier, count(*) AS n FROM alike GROUP BY 1),
           told AS (SELECT a.term, id, round(score, 6) AS score, CASE WHEN n > 1 THEN 'AMBIGUOUS' ELSE tier END AS tier, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM a LEFT JOIN best ON a.term = best.term)"""


def asked(g: Graph) -> DataFrame:
    """Ids that exist and that do not, names in capitals, with a doubled letter, empty ones, and what is like no name."""
    n, name, brand = F.col("p_partkey"), F.col("p_name"), F.concat(F.lit(" "), F.col("p_brand"))
    doubled = F.concat(name.substr(1, 3), name.substr(F.lit(3), F.length(name)), brand)
    kinds = [F.concat(F.lit("C:"), n.cast("string")), F.concat(F.lit("C:x"), n.cast("string")), F.concat(F.upper(name), brand), F.lit(""), doubled]
    term = F.when(n % 6 == 5, F.concat(F.lit("~~~~~~~~"), n.cast("string")))
    for i, kind in enumerate(kinds):
        term = term.when(n % 6 == i, kind)
    return g.table("part").select(term.alias("term"))


def branded(g: Graph) -> DataFrame:
    return g.table("part").select(F.concat(F.lit("C:"), F.col("p_partkey").cast("string")).alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))


@query(f"WITH {MATCHED} SELECT * FROM told")
def e9_resolve_pipeline(g: Graph) -> DataFrame:
    """Identifiers, names, fuzzy names at 0.85: resolved, ambiguous and unresolved terms, with tiers."""
    return resolve.resolved(asked(g), branded(g), F.col("term").startswith("C:")).withColumn("score", F.round("score", 6))


NAMED = "(SELECT c_custkey AS id, lower(trim(regexp_replace(CASE c_custkey % 6 WHEN 0 THEN 'IBD' WHEN 1 THEN ' T2D ' WHEN 2 THEN 'Crohn''s  Disease' WHEN 3 THEN 'Non-Alcoholic ' || c_mktsegment WHEN 4 THEN c_name ELSE '' END, '\\s+', ' ', 'g'))) AS squeezed FROM customer)"


def named(g: Graph):
    n = F.col("c_custkey") % 6
    return F.when(n == 0, "IBD").when(n == 1, " T2D ").when(n == 2, "Crohn's  Disease").when(n == 3, F.concat(F.lit("Non-Alcoholic "), F.col("c_mktsegment"))).when(n == 4, F.col("c_name")).otherwise("")


@query(f"SELECT id, {NORMAL} AS norm FROM {NAMED} LEFT JOIN {SHORT} ON m.short = squeezed")
def e11_normalise_disease(g: Graph) -> DataFrame:
    return g.table("customer").select(F.col("c_custkey").alias("id"), normal_disease(named(g)).alias("norm"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 'DOID:' || id WHEN id % 5 = 0 THEN 'MESH:D' || id WHEN id % 7 = 0 THEN 'ICD10:K' || (id % 90) ELSE 'disease:' || replace({NORMAL}, ' ', '_') END AS disease_id FROM {NAMED} LEFT JOIN {SHORT} ON m.short = squeezed")
def e12_disease_id(g: Graph) -> DataFrame:
    n = F.col("c_custkey")
    one = lambda by, value: F.when(n % by == 0, value).otherwise("")
    none = F.lit(None).cast("string")
    return g.table("customer").select(n.alias("id"), disease_id(one(3, n.cast("string")), one(5, F.concat(F.lit("D"), n.cast("string"))), none, F.lit(""), one(7, F.concat(F.lit("K"), (n % 90).cast("string"))), named(g)).alias("disease_id"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN 'CID:' || p_partkey END) AS compound_id FROM part")
def e13_compound_id(g: Graph) -> DataFrame:
    key = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")
    cid = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("CID:"), F.col("p_partkey").cast("string")))
    return g.table("part").select("p_partkey", first_filled(key, cid).alias("compound_id"))


@query(f"WITH l AS (SELECT *, row({LINE_ORDER}) AS seq FROM lineitem) SELECT 'Supplier' AS label, CAST(l_suppkey AS VARCHAR) AS id, arg_max(l_returnflag, seq) AS flag, arg_max(l_quantity, seq) AS quantity FROM l GROUP BY 2 UNION ALL SELECT 'edge', l_suppkey || '>' || l_partkey, arg_min(l_returnflag, seq), NULL FROM l GROUP BY 2")
def e14_rows_to_graph(g: Graph) -> DataFrame:
    """Later rows overwrite an entity's properties; the first row of an edge wins."""
    rows = g.table("lineitem").withColumn("seq", F.expr(f"struct({LINE_ORDER})"))
    nodes = resolve.entities(rows, F.lit("Supplier"), F.col("l_suppkey"), {"flag": F.col("l_returnflag"), "quantity": F.col("l_quantity")}, "seq")
    edges = resolve.relations(rows, "SUPPLIES", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_returnflag"), "seq")
    return nodes.unionAll(edges.select(F.lit("edge"), F.concat_ws(">", "src", "dst"), "value", F.lit(None).cast("double")))


@query("""WITH t AS (SELECT p_type AS label, p_partkey AS k, unnest([p_brand || ':' || p_size, 'name:' || p_name]) AS token FROM part)
          SELECT label, 'A' || a.k AS a_id, 'B' || b.k AS b_id, string_agg(DISTINCT token, '|' ORDER BY token) AS shared FROM t a JOIN t b USING (label, token) GROUP BY 1, 2, 3""")
def e16_same_as(g: Graph) -> DataFrame:
    """Both snapshots hold the whole table."""
    tokens = F.array(F.concat_ws(":", "p_brand", F.col("p_size").cast("string")), F.concat(F.lit("name:"), F.col("p_name"))).alias("tokens")
    of = lambda prefix: g.table("part").select(F.col("p_type").alias("label"), F.concat(F.lit(prefix), F.col("p_partkey").cast("string")).alias("id"), tokens)
    return resolve.same_as(of("A"), of("B"))


def row_hash_sql(*columns: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"


SUMS = " || ':' || ".join(["count(*)", *(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT))" for i in range(8))])


@query(f"SELECT part, count(*) AS rows, sha256({SUMS}) AS sha256 FROM (SELECT label AS part, {row_hash_sql('id', 'name', 'org')} AS h FROM nodes UNION ALL SELECT type, {row_hash_sql('src', 'dst')} FROM edges) GROUP BY 1")
def e17_bundle_manifest(g: Graph) -> DataFrame:
    """Rows and digest of every file of a bundle, one a label and type; the rows of a file have no order."""
    from quillgraph.sources.sinks import digests, row_hash

    nodes = g.nodes.select(F.col("label").alias("part"), row_hash("id", "name", "org").alias("h"))
    return digests(nodes.unionAll(g.edges.select("type", row_hash("src", "dst"))))


@query("SELECT id, CASE label WHEN 'Taxon' THEN 'OrganismTaxon' WHEN 'Compound' THEN 'ChemicalEntity' WHEN 'Drug' THEN 'ChemicalEntity' ELSE label END AS class FROM nodes")
def e18_label_remap(g: Graph) -> DataFrame:
    remap = F.create_map(*(F.lit(x) for x in ("Taxon", "OrganismTaxon", "Compound", "ChemicalEntity", "Drug", "ChemicalEntity", "Disease", "Disease", "Pathway", "Pathway", "Protein", "Protein")))
    return g.nodes.select("id", F.element_at(remap, F.col("label")).alias("class"))


@query("SELECT p_partkey, CASE WHEN p_size >= 40 AND p_type = 'PROMO' THEN 'private' WHEN p_brand = 'Brand#3' THEN 'partner' WHEN p_size <= 5 THEN 'small' ELSE 'core' END AS destination FROM part")
def e19_routing(g: Graph) -> DataFrame:
    """First matching rule; the second one has an unknown condition and so never matches."""
    rules = [({"tier": "PROMO", "min_rows": 40}, "private"), ({"region": "EU"}, "nowhere"), ({"contributor": "Brand#3"}, "partner"), ({"max_rows": 5}, "small")]
    rows = g.table("part").select("p_partkey", F.col("p_type").alias("tier"), F.col("p_brand").alias("contributor"), F.col("p_size").alias("rows"))
    return rows.select("p_partkey", resolve.routed([(resolve.rule_condition(m), d) for m, d in rules], "core").alias("destination"))


@query("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN false WHEN p_type = 'PROMO' THEN true WHEN p_size < 20 THEN true WHEN p_size < 30 THEN false WHEN p_size < 40 THEN true ELSE false END AS allowed FROM part")
def e20_license(g: Graph) -> DataFrame:
    use = F.when(F.col("p_size") < 20, "allowed").when(F.col("p_size") < 30, "restricted").when(F.col("p_size") < 40, "unknown").otherwise("prohibited")
    return g.table("part").select("p_partkey", resolve.licensed(F.col("p_brand"), F.col("p_type"), use, ["Brand#1", "Brand#2"], ["PROMO"], True, False, True).alias("allowed"))


@query(f"WITH {MATCHED} SELECT status, count(*) AS n FROM told GROUP BY 1")
def e22_confidence_report(g: Graph) -> DataFrame:
    return e9_resolve_pipeline(g).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(trim(text)), '\s+')) AS w FROM documents), c AS (SELECT doc_id, CAST(('0x' || substr(sha256(w), 63, 2))::INTEGER & 63 AS INTEGER) AS place, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2)
           SELECT doc_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS weight FROM c""")
def r7_hash_embedding(g: Graph) -> DataFrame:
    """Bags of words hashed to 64 places by SHA-256, of length one; sparse: doc_id, place, weight."""
    words = g.table("documents").select("doc_id", F.explode(F.split(F.lower(F.trim("text")), r"\s+")).alias("w")).filter("w != ''")
    # 256-bit remainder by 64: the last six bits.
    place = F.conv(F.substring(F.sha2("w", 256), 63, 2), 16, 10).cast("int").bitwiseAND(F.lit(63))
    counts = words.select("doc_id", place.alias("place")).groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("n"))
    norms = counts.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, "doc_id").select("doc_id", "place", F.round(F.col("n") / F.col("norm"), 9).alias("weight"))


def profile_sql(table: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", CASE WHEN count(v) = 0 THEN 'unknown' WHEN bool_and(regexp_full_match(v, '[+-]?\\d+')) THEN 'integer' WHEN bool_and(regexp_full_match(v, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')) THEN 'float' WHEN bool_and(regexp_full_match(v, '(?i)(true|false)')) THEN 'boolean' ELSE 'string' END AS inferred_type,
             round((count(*) - count(v)) * 1.0 / count(*), 4) AS null_rate, count(DISTINCT v) AS distinct_count FROM (SELECT nullif(CAST({c} AS VARCHAR), '') AS v FROM {t})"""
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


PROFILED = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(profile_sql("part", PROFILED))
def p1_profile(g: Graph) -> DataFrame:
    return profile(g.table("part"), PROFILED)


@query(profile_sql("(SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'true' END AS flag, event_type FROM events)", ["k", "flag", "event_type"]))
def p2_profile_json(g: Graph) -> DataFrame:
    rows = g.table("events").select(F.get_json_object("props", "$.k").alias("k"), F.when(F.col("event_id") % 4 == 0, "").otherwise("true").alias("flag"), "event_type")
    return profile(rows)


STORED = {
    "embeddings": {"vec_id": "integer", "embedding": "json", "label": "integer"},
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "string"},
    "events": {"event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "string", "value": "float", "props": "string"},
}


@query(" UNION ALL ".join(f"""SELECT '{t}' AS "table", '{c}' AS "column", '{tag}' AS tag, count({c}) AS filled, count(*) AS n FROM {t}""" for t, columns in STORED.items() for c, tag in columns.items()))
def p3_parquet_tags(g: Graph) -> DataFrame:
    """Stored types of all columns and how many rows fill them: one aggregation a table."""
    out = None
    for table in STORED:
        rows = typed_columns(g.table(table)).select(F.lit(table).alias("table"), "column", "tag", "filled", "n")
        out = rows if out is None else out.unionAll(rows)
    return out


@query("SELECT key, count(*) AS n FROM (SELECT unnest(list_transform(string_split('type=' || event_type || ';user=' || user_id, ';'), lambda x: split_part(x, '=', 1))) AS key FROM events) GROUP BY 1")
def p7_attribute_keys(g: Graph) -> DataFrame:
    attributes = F.concat(F.lit("type="), F.col("event_type"), F.lit(";user="), F.col("user_id").cast("string"))
    return g.table("events").select(F.explode(F.map_keys(F.str_to_map(attributes, F.lit(";"), F.lit("="))))).toDF("key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sum(len(string_split(text, chr(10))))::BIGINT AS lines, count(*) FILTER (starts_with(text, '>')) AS fasta FROM documents".replace("sum(len(string_split(text, chr(10))))::BIGINT", "CAST(sum(len(string_split(text, chr(10)))) AS BIGINT)"))
def p10_raw_counts(g: Graph) -> DataFrame:
    return g.table("documents").agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.count_if(F.col("text").startswith(">")).alias("fasta"))


@query("SELECT '|' AS delimiter, CAST(3 AS BIGINT) AS parts")
def p11_structured(g: Graph) -> DataFrame:
    rows = g.table("part").select(F.concat_ws("|", "p_brand", "p_name", "p_type").alias("v"))
    return delimited(rows, "v")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'enriched' WHEN 'O' THEN 'depleted' ELSE 'altered' END AS direction FROM orders")
def i2_direction_lexicon(g: Graph) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", "Elevated").when(F.col("o_orderstatus") == "O", "REDUCED").otherwise("unchanged")
    return g.table("orders").select("o_orderkey", direction_of(outcome).alias("direction"))


@query("SELECT c_custkey AS row_id, name, CASE WHEN i <= 2 THEN id ELSE '' END AS id FROM (SELECT c_custkey, unnest(['A ' || c_name, 'Sp x', c_mktsegment]) AS name, unnest([CAST(c_custkey AS VARCHAR), '9', NULL]) AS id, unnest([1, 2, 3]) AS i FROM customer)")
def i3_signature_pairs(g: Graph) -> DataFrame:
    from quillgraph.sources.loaders import signature_taxa

    rows = g.table("customer").select(F.col("c_custkey").alias("row_id"), F.concat(F.lit("A "), F.col("c_name"), F.lit("; k__B|s__Sp_x ;;"), F.col("c_mktsegment")).alias("names"), F.concat(F.col("c_custkey").cast("string"), F.lit("; 9")).alias("ids"))
    return signature_taxa(rows, "names", "ids").select("row_id", "name", "id")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'enriched' WHEN 'error' THEN 'depleted' ELSE 'altered' END AS direction FROM events WHERE event_type IN ('click', 'error', 'view') AND user_id % 2 = 0")
def i13_predicates(g: Graph) -> DataFrame:
    from quillgraph.sources.loaders import predications

    predicate = F.when(F.col("event_type") == "click", "CAUSES").when(F.col("event_type") == "error", "TREATS").when(F.col("event_type") == "view", "AFFECTS").otherwise("ISA")
    rows = g.table("events").select("event_id", predicate.alias("predicate"), F.when(F.col("user_id") % 2 == 0, "bact").otherwise("humn").alias("subject_type"), F.lit("dsyn").alias("object_type"))
    return predications(rows).select("event_id", "direction")


@query("SELECT l_suppkey, TRY_CAST(CASE WHEN l_linenumber % 3 = 0 THEN 'NA' ELSE CAST(l_quantity AS VARCHAR) END AS DOUBLE) AS abundance FROM lineitem")
def i14_coercion(g: Graph) -> DataFrame:
    value = F.when(F.col("l_linenumber") % 3 == 0, "NA").otherwise(F.col("l_quantity").cast("string"))
    return g.table("lineitem").select("l_suppkey", value.try_cast("double").alias("abundance"))


@query("SELECT p_partkey, 'S' || p_size AS site, CASE p_partkey % 3 WHEN 0 THEN 'phosphorylation' WHEN 1 THEN 'acetylation' END AS ptm FROM part WHERE p_partkey % 3 < 2")
def i17_residues(g: Graph) -> DataFrame:
    from quillgraph.sources.loaders import residues

    suffix = F.when(F.col("p_partkey") % 3 == 0, "-p").when(F.col("p_partkey") % 3 == 1, "-ac").otherwise("-xx")
    rows = g.table("part").select("p_partkey", F.concat(F.lit("S"), F.col("p_size").cast("string"), suffix).alias("mod_rsd"))
    return residues(rows, "mod_rsd").select("p_partkey", "site", "ptm")


@query("SELECT l_orderkey, l_partkey, 'CURIE:' || l_suppkey AS target, l_discount AS score FROM lineitem WHERE l_discount >= 0.09")
def i21_score_pushdown(g: Graph) -> DataFrame:
    """Column pruning and the score threshold reach the scan."""
    return g.table("lineitem").filter("l_discount >= 0.09").select("l_orderkey", "l_partkey", F.concat(F.lit("CURIE:"), F.col("l_suppkey").cast("string")).alias("target"), F.col("l_discount").alias("score"))


@query("SELECT src, dst, type FROM edges WHERE src NOT IN (SELECT drug_id FROM drug) AND dst NOT IN (SELECT pathway_id FROM pathway)")
def i22_drop_types(g: Graph) -> DataFrame:
    """Nodes of excluded types go, and with them their edges."""
    from quillgraph.sources.readers import primekg

    kept = {t: t for t in ("Taxon", "Disease", "Compound", "Protein")}
    nodes = g.nodes.select(F.col("id").alias("node_index"), F.col("label").alias("node_type"))
    edges = g.edges.select(F.col("src").alias("x_index"), F.col("dst").alias("y_index"), "type")
    return primekg(nodes, edges, kept)[1].select(F.col("x_index").alias("src"), F.col("y_index").alias("dst"), "type")
