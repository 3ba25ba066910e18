"""Formats written from the tables into the shared folder and read back, and sources through their library transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.lineage import scratch
from quillgraph.plans.registry import query
from quillgraph.plans.views import Graph
from quillgraph.sources import loaders, readers, records


def written(rows: DataFrame, line: Column) -> str:
    """A folder of text with a line a row."""
    at = scratch(rows.sparkSession)
    rows.select(line.alias("value")).write.text(at)
    return at


def text(column: str) -> Column:
    return F.col(column).cast("string")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || '''s (x)' AS c_name, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def p4_sql_dump(g: Graph) -> DataFrame:
    """Customers as a dump, whose other table's rows are left out."""
    segment = F.when(F.col("c_custkey") % 9 == 0, "NULL").otherwise(F.concat(F.lit("'"), "c_mktsegment", F.lit("'")))
    values = F.concat(F.lit("("), text("c_custkey"), F.lit(", '"), "c_name", F.lit("''s (x)', "), segment, F.lit(");"))
    rows = g.table("customer").select(F.concat(F.lit("INSERT INTO `customer` VALUES "), values).alias("v"))
    other = g.table("supplier").select(F.concat(F.lit("INSERT INTO other VALUES ("), text("s_suppkey"), F.lit(");")).alias("v"))
    head = g.spark.createDataFrame([("-- a dump\nCREATE TABLE IF NOT EXISTS `customer` (\n  `c_custkey` BIGINT,\n  `c_name` TEXT,\n  c_mktsegment VARCHAR(20),\n  PRIMARY KEY (c_custkey)\n);",)], "v string")
    return readers.sql_dump(g.spark, written(head.unionAll(other).unionAll(rows), F.col("v")))


@query("""SELECT 'chr' || l_linenumber AS chrom, l_orderkey AS pos, CASE WHEN l_suppkey % 4 <> 0 THEN 'rs' || l_suppkey END AS id, l_returnflag AS ref, l_linestatus AS alt, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS qual, 'PASS' AS "filter", 'DP=' || l_partkey AS info FROM lineitem""")
def p6_variants(g: Graph) -> DataFrame:
    """Lines of orders as variants; dots are null."""
    known = F.when(F.col("l_suppkey") % 4 == 0, ".").otherwise(F.concat(F.lit("rs"), text("l_suppkey")))
    quality = F.when(F.col("l_partkey") % 3 == 0, ".").otherwise(text("l_quantity"))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), text("l_linenumber")), text("l_orderkey"), known, "l_returnflag", "l_linestatus", quality, F.lit("PASS"), F.concat(F.lit("DP="), text("l_partkey")))
    return readers.vcf(g.spark, written(g.table("lineitem"), line))


@query("SELECT key, count(*) AS n, sum(CAST(event_id AS BIGINT))::BIGINT AS starts FROM (SELECT event_id, unnest(CASE WHEN user_id % 2 = 0 THEN ['ID', 'type'] ELSE ['gene_id', 'note'] END) AS key FROM events) GROUP BY 1".replace("sum(CAST(event_id AS BIGINT))::BIGINT", "CAST(sum(event_id) AS BIGINT)"))
def p7_features(g: Graph) -> DataFrame:
    """Events as features in both dialects of attributes; keys counted, with the sum of where their features start."""
    pairs = F.concat(F.lit("ID="), text("event_id"), F.lit(";type="), "event_type")
    quoted = F.concat(F.lit('gene_id "'), text("event_id"), F.lit('"; note "'), "event_type", F.lit('";'))
    line = F.concat_ws("\t", F.lit("c"), F.lit("s"), F.lit("gene"), text("event_id"), text("user_id"), F.lit("."), F.lit("+"), F.lit("."), F.when(F.col("user_id") % 2 == 0, pairs).otherwise(quoted))
    found = readers.gff(g.spark, written(g.table("events"), line))
    return found.select(F.explode(F.map_keys("attributes")).alias("key"), "start").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"))


@query("""SELECT 'u' || user_id AS chrom, event_id AS start, event_id + 5 AS "end", event_type AS name FROM events""")
def p7_intervals(g: Graph) -> DataFrame:
    line = F.concat_ws("\t", F.concat(F.lit("u"), text("user_id")), text("event_id"), (F.col("event_id") + 5).cast("string"), "event_type")
    return readers.bed(g.spark, written(g.table("events"), line))


@query("SELECT 'fasta' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'fastq', count(*) FROM orders UNION ALL SELECT 'sam', count(*) FROM lineitem")
def p10_reads(g: Graph) -> DataFrame:
    """How many reads files of each kind hold; a text's line that begins like a record is kept apart by a letter."""
    parts = {
        "fasta": written(g.table("documents"), F.concat(F.lit(">"), text("doc_id"), F.lit("\nA"), F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", "A"))),
        "fastq": written(g.table("orders"), F.concat(F.lit("@"), text("o_orderkey"), F.lit("\nACGT\n+\n>@#I"))),
        "sam": written(g.table("lineitem"), F.when((F.col("l_linenumber") == 1), F.concat(F.lit("@CO\tnote\n"), text("l_orderkey"))).otherwise(text("l_orderkey"))),
    }
    out = None
    for kind, at in parts.items():
        one = readers.reads(g.spark, at, kind).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("""SELECT CASE WHEN o_custkey % 4 <> 0 THEN 'NCBITaxon:' || o_custkey ELSE 'disbiome:Org ' || o_custkey END AS taxon_id, CASE WHEN o_orderkey % 5 = 0 THEN 'DOID:' || o_orderkey ELSE 'disease:ward_' || lower(replace(replace(o_orderpriority, '-', '_'), ' ', '_')) END AS disease_id,
          CASE o_orderstatus WHEN 'F' THEN 'enriched' WHEN 'O' THEN 'depleted' ELSE 'altered' END AS direction, CAST(o_orderkey AS VARCHAR) AS pmid FROM orders WHERE o_orderkey % 7 <> 0""")
def i2_disbiome(g: Graph) -> DataFrame:
    """Orders as associations: identifiers of either kind, outcomes by the lexicon, nameless diseases left out."""
    key, person = F.col("o_orderkey"), F.col("o_custkey")
    rows = g.table("orders").select(
        F.concat(F.lit("Org "), text("o_custkey")).alias("microorganism"),
        F.when(person % 4 != 0, F.concat(F.lit(" "), text("o_custkey"))).otherwise("").alias("ncbi_taxid"),
        F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("Ward-"), "o_orderpriority")).alias("disease"),
        F.when(key % 5 == 0, F.concat(F.lit("DOID:"), text("o_orderkey"))).alias("doid"),
        F.when(F.col("o_orderstatus") == "F", "Elevated").when(F.col("o_orderstatus") == "O", "REDUCED").alias("qualitative_outcome"),
        key.alias("pmid"),
    )
    return loaders.disbiome(rows).select("taxon_id", "disease_id", "direction", "pmid")


@query("""SELECT CASE WHEN l_suppkey % 3 <> 0 THEN 'NCBITaxon:' || l_suppkey ELSE 'mbodymap:t_' || l_suppkey END AS src, 'bodysite:' || lower(l_linestatus) AS dst, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS relative_abundance, l_discount AS prevalence FROM lineitem WHERE l_returnflag <> 'N'""")
def i14_body_sites(g: Graph) -> DataFrame:
    """Lines as taxa of body sites; what is no number becomes null, rows without a site go."""
    rows = g.table("lineitem").select(
        F.concat(F.lit("T "), text("l_suppkey")).alias("taxon_name"),
        F.when(F.col("l_suppkey") % 3 != 0, text("l_suppkey")).alias("ncbi_tax_id"),
        F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_linestatus")).alias("body_site"),
        F.when(F.col("l_linenumber") % 3 == 0, "NA").otherwise(text("l_quantity")).alias("relative_abundance"),
        text("l_discount").alias("prevalence"),
    )
    return records.body_sites(rows)[1].select("src", "dst", "relative_abundance", "prevalence")


@query("SELECT 'EFO:' || l_suppkey AS disease, 'ENSEMBL:E' || l_partkey AS target, l_discount AS score FROM lineitem WHERE l_discount >= 0.05")
def i21_open_targets(g: Graph) -> DataFrame:
    """A stored table of associations, of which three columns are read and the score's bound reaches the scan."""
    at = scratch(g.spark)
    columns = [F.concat(F.lit("EFO_"), text("l_suppkey")).alias("diseaseId"), F.concat(F.lit("E"), text("l_partkey")).alias("targetId"), F.col("l_discount").alias("score"), "l_shipdate", "l_tax"]
    g.table("lineitem").select(*columns).write.parquet(at)
    return readers.open_targets(g.spark, at, 0.05)
