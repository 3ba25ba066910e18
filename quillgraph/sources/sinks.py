"""Sinks: graph bundles as one folder of Parquet a label and type, with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bundle(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes (label, id, ...) and edges (type, src, dst, ...), partitioned so that later reads prune."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, rows: what a dry run would submit."""
    nodes, edges = read_bundle(spark, path)
    counted = lambda df, c: df.groupBy(F.col(c).alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    return counted(nodes, "label").unionByName(counted(edges, "type"))


def row_hash(*columns: str) -> Column:
    """SHA-256 of a row: each value with its length in bytes before it, a null as a dash."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.sha2(F.concat(*(value(c) for c in columns)), 256)


def digests(rows: DataFrame) -> DataFrame:
    """part, rows, sha256 of the rows (part, h) of each part, in any order: the eight 32-bit pieces of the row hashes are
    summed, so nothing is gathered, and the digest is that of their number and sums."""
    piece = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    summed = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), *(F.sum(piece(i)).alias(f"s{i}") for i in range(8)))
    return summed.select("part", "rows", F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("rows", *(f"s{i}" for i in range(8))))), 256).alias("sha256"))
