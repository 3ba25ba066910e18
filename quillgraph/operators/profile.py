"""Profiles of columns: inferred type, nulls, distinct values, delimiters; all columns in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, BOOLEAN = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"^(?i:true|false)$"
DELIMITERS = (";", "|", "::")


def tag_of(kind: T.DataType) -> str:
    """The profile's name for a stored type."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return "json"
    return "string"


def typed_columns(rows: DataFrame) -> DataFrame:
    """column, tag, filled, n: the stored type of each column and how many of the n rows have a value there."""
    counted = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(rows.schema)))
    told = F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(tag_of(f.dataType)).alias("tag"), F.col(f"c{i}").alias("filled")) for i, f in enumerate(rows.schema)))
    return counted.select(F.explode(told).alias("t"), "n").select("t.*", "n")


def profile(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, inferred_type, null_rate, distinct_count: values as text, empty ones null.

    The columns become (column, value) rows, so that one hash aggregation with map-side partials does them all.
    """
    names = columns or rows.columns
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names)))
    long = rows.select(pairs.alias("p")).select("p.column", F.when(F.col("p.value") != "", F.col("p.value")).alias("value"))
    counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    fits = lambda p: F.bool_and(F.when(F.col("value").isNotNull(), F.col("value").rlike(p)))
    nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    kind = F.when(F.count("value") == 0, "unknown").when(fits(INTEGER), "integer").when(fits(FLOAT), "float").when(fits(BOOLEAN), "boolean").otherwise("string")
    return counted.groupBy("column").agg(kind.alias("inferred_type"), F.round(nulls / F.sum("n"), 4).alias("null_rate"), F.count("value").alias("distinct_count"))


def times(value: Column, delimiter: str) -> Column:
    return ((F.length(value) - F.length(F.replace(value, F.lit(delimiter), F.lit("")))) / len(delimiter)).cast("long")


def delimited(rows: DataFrame, column: str, delimiters: tuple[str, ...] = DELIMITERS) -> DataFrame:
    """delimiter, parts: the first delimiter that every value has equally often; no row if there is none."""
    value = F.when(F.col(column) != "", F.col(column))
    stats = [F.struct(F.lit(i).alias("i"), F.lit(d).alias("delimiter"), F.min(times(value, d)).alias("low"), F.max(times(value, d)).alias("high")) for i, d in enumerate(delimiters)]
    found = rows.agg(F.array(*stats).alias("s"), F.count(value).alias("n")).select(F.explode("s").alias("s"), "n").filter("n >= 2 AND s.low = s.high AND s.low > 0")
    return found.groupBy().agg(F.min(F.struct("s.i", "s.delimiter", "s.low")).alias("s")).filter("s IS NOT NULL").select("s.delimiter", (F.col("s.low") + 1).alias("parts"))
