"""Readers: files of each format as DataFrames. Spark opens every path, so any store that it knows will do."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value; gz and bz2 are opened as such."""
    return spark.read.text(path)


def delimited(spark: SparkSession, path: str, delimiter: str | None = None, comment: str | None = None) -> DataFrame:
    """A table with a header, all columns text; without a delimiter the header line tells it."""
    if delimiter is None:
        head = lines(spark, path).filter(~F.col("value").startswith(comment or "\0")).limit(1).collect()
        text = head[0][0] if head else ""
        delimiter = max("\t,;|", key=text.count)
    reader = spark.read.option("header", True).option("sep", delimiter).option("inferSchema", False).option("quote", '"').option("escape", '"').option("multiLine", False)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def headed(spark: SparkSession, path: str, first: str, sep: str = "\t") -> DataFrame:
    """A table whose header, which begins with a column of a known name, stands below some lines of prose; all text."""
    head = lines(spark, path).filter(F.col("value").startswith(first + sep)).limit(1).collect()
    if not head:
        raise ValueError(f"no header that begins with {first}")
    names = [n.strip() for n in head[0][0].split(sep)]
    fields = lines(spark, path).filter(F.col("value") != head[0][0]).select(F.split("value", re.escape(sep)).alias("f")).filter(F.size("f") == len(names))
    return fields.select(*(F.col("f")[i].alias(n) for i, n in enumerate(names)))


def json_records(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """One object a line, or a file that is one array of objects."""
    return spark.read.option("multiLine", array).json(path)


def taxdump(spark: SparkSession, nodes: str, names: str) -> tuple[DataFrame, DataFrame]:
    """(tax_id, parent_id, rank) and (tax_id, name, name_class) from bar-delimited taxonomy files."""

    def fields(path: str) -> DataFrame:
        return lines(spark, path).select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("f"))

    n = fields(nodes).select(F.col("f")[0].cast("long").alias("tax_id"), F.col("f")[1].cast("long").alias("parent_id"), F.col("f")[2].alias("rank"))
    m = fields(names).select(F.col("f")[0].cast("long").alias("tax_id"), F.col("f")[1].alias("name"), F.col("f")[3].alias("name_class"))
    return n, m


def xml_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One row an element of a large XML file."""
    return spark.read.format("xml").option("rowTag", tag).load(path)


def flat_records(spark: SparkSession, path: str, end: str = "///") -> DataFrame:
    """record: an array of (key, value) of flat-file records; indented lines go on with the key before them."""
    raw = spark.read.option("lineSep", f"{end}\n").text(path).filter(F.trim("value") != "")
    joined = F.regexp_replace("value", r"\n\s+", " ; ")
    fields = F.filter(F.split(joined, "\n"), lambda x: F.trim(x) != "")
    pair = lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("key"), F.trim(F.regexp_replace(x, r"^\S+(\s+-\s+|\s+)?", "")).alias("value"))
    return raw.select(F.transform(fields, pair).alias("record"))


def field(record: Column, key: str) -> Column:
    """The first value of a key in a record."""
    return F.get(F.transform(F.filter(record, lambda f: f["key"] == key), lambda f: f["value"]), F.lit(0))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """The fixed columns of variants; a dot is null."""
    f = lines(spark, path).filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]
    value = lambda i: F.nullif(F.get("f", F.lit(i)), F.lit("."))
    out = f.select(*(value(i).alias(n) for i, n in enumerate(names)))
    return out.withColumn("pos", F.col("pos").try_cast("long")).withColumn("qual", F.col("qual").try_cast("double"))


def gff(spark: SparkSession, path: str) -> DataFrame:
    """Features with their attributes as a map; key=value and key "value" forms."""
    f = lines(spark, path).filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    attributes = F.regexp_replace(F.regexp_replace(F.col("f")[8], r'(\w+)\s+"([^"]*)"', "$1=$2"), r";\s*", ";")
    pairs = F.str_to_map(F.regexp_replace(attributes, ";$", ""), F.lit(";"), F.lit("="))
    return f.select(F.col("f")[0].alias("seqid"), F.col("f")[2].alias("type"), F.col("f")[3].try_cast("long").alias("start"), F.col("f")[4].try_cast("long").alias("end"), F.col("f")[6].alias("strand"), pairs.alias("attributes"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    f = lines(spark, path).filter(~F.col("value").rlike("^(#|track|browser)") & (F.col("value") != "")).select(F.split("value", r"\s+").alias("f"))
    return f.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"), F.get("f", F.lit(3)).alias("name"))


def reads(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """n: the reads of a fastq, fasta or sam file."""
    v = F.col("value")
    count = {"fastq": F.floor(F.count(F.lit(1)) / 4), "fasta": F.count_if(v.startswith(">")), "sam": F.count_if(~v.startswith("@") & (v != ""))}[kind]
    return lines(spark, path).agg(count.alias("n"))


def biom(spark: SparkSession, path: str) -> DataFrame:
    """row, column, value of a sparse or dense matrix; zeros are absent."""
    one = spark.read.option("multiLine", True).schema("matrix_type string, rows array<struct<id:string>>, columns array<struct<id:string>>, data array<array<double>>").json(path)
    sparse = one.filter("matrix_type = 'sparse'").select("rows", "columns", F.explode("data").alias("d")).select(F.col("rows")[F.col("d")[0].cast("int")]["id"].alias("row"), F.col("columns")[F.col("d")[1].cast("int")]["id"].alias("column"), F.col("d")[2].alias("value"))
    dense = one.filter("matrix_type = 'dense'").select("rows", "columns", F.posexplode("data").alias("i", "d")).select("rows", "columns", "i", F.posexplode("d").alias("j", "value")).select(F.col("rows")[F.col("i")]["id"].alias("row"), F.col("columns")[F.col("j")]["id"].alias("column"), "value")
    return sparse.unionByName(dense).filter("value != 0")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """i, j (from 1), value of a coordinate matrix; the first line without % holds the sizes and goes."""
    f = lines(spark, path).filter(~F.col("value").startswith("%") & (F.col("value") != "")).select(F.monotonically_increasing_id().alias("k"), F.split("value", r"\s+").alias("f"))
    first = f.agg(F.min("k").alias("k"))
    return f.join(F.broadcast(first), "k", "left_anti").select(F.col("f")[0].cast("long").alias("i"), F.col("f")[1].cast("long").alias("j"), F.col("f")[2].cast("double").alias("value"))  # one row


def sql_dump(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a dump inserts into its first table, columns by their declared names, all text."""
    statements = spark.read.option("lineSep", ";\n").text(path).filter(F.col("value").rlike(r"(?is)^(\s*|.*\n\s*)create table\s"))
    first = statements.limit(1).collect()  # the one statement, wherever it stands
    made = first and re.search(r"^\s*create table\s+(?:if not exists\s+)?[`\"]?(\w+)[`\"]?\s*\((.*?)\n\s*\)", first[0][0], re.I | re.S | re.M) or None
    if made is None:
        raise ValueError("no CREATE TABLE in the dump")
    names = [m[1] for line in made[2].split("\n") if (m := re.match(r"\s*[`\"]?(\w+)[`\"]?\s+\w+", line)) and m[1].upper() not in ("PRIMARY", "KEY", "UNIQUE", "CONSTRAINT", "FOREIGN")]
    own = lines(spark, path).filter(F.col("value").rlike(rf"(?i)^\s*insert into\s+[`\"]?{made[1]}[`\"]?\b") | F.col("value").rlike(r"^\s*\("))
    tuples = F.regexp_extract_all("value", F.lit(r"\(((?:[^()']|'(?:[^']|'')*')*)\)(?=\s*[,;]|\s*$)"), F.lit(1))
    values = F.regexp_extract_all("t", F.lit(r"\s*('(?:[^']|'')*'|[^,]+)\s*(?:,|$)"), F.lit(1))
    rows = own.select(F.explode(tuples).alias("t")).select(values.alias("v"))
    clean = lambda v: F.when(F.upper(F.trim(v)) == "NULL", None).otherwise(F.replace(F.regexp_replace(F.trim(v), "^'|'$", ""), F.lit("''"), F.lit("'")))
    return rows.select(*(clean(F.get("v", F.lit(i))).alias(n) for i, n in enumerate(names)))


def open_targets(spark: SparkSession, path: str, least: float = 0.2) -> DataFrame:
    """Associations with a score of at least `least`: the columns and the threshold reach the scan."""
    return spark.read.parquet(path).select("diseaseId", "targetId", "score").filter(F.col("score") >= least).select(F.replace("diseaseId", F.lit("_"), F.lit(":")).alias("disease"), F.concat(F.lit("ENSEMBL:"), F.col("targetId")).alias("target"), "score")


def primekg(nodes: DataFrame, edges: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes with mapped labels and the edges between them; other types go, and their edges."""
    names = F.create_map(*(F.lit(x) for kv in types.items() for x in kv))
    kept = nodes.withColumn("label", F.element_at(names, F.col("node_type"))).filter("label IS NOT NULL")
    ids = kept.select("node_index")
    both = edges.join(ids.withColumnRenamed("node_index", "x_index"), "x_index", "left_semi").join(ids.withColumnRenamed("node_index", "y_index"), "y_index", "left_semi")
    return kept, both
