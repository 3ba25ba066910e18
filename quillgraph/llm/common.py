"""What the operators share: the shared folder, written tables, Arrow text columns, held-out rows."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.lineage import shared_dir


#: Shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends here, and its shuffle files go.

    dictionary: whether values may be encoded by dictionaries; where nearly all differ that costs much time, and so does
    to compress them hard.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        quick = {} if dictionary else {"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"}
        df.write.options(compression="zstd", **quick).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As written(), in buckets by key, each sorted: joins by the key neither shuffle nor sort it again."""
    spark = df.sparkSession
    table, path = f"quillgraph_{name}_{uuid.uuid4().hex}", f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(table)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.table(table)
    out._written_to, out._table = path, table
    return out


def own(df: DataFrame, name: str) -> Column:
    """The column with just this name, also where others differ from it in case only."""
    if sum(c.lower() == name.lower() for c in df.columns) < 2:
        return df[name]
    spark, key = df.sparkSession, "spark.sql.caseSensitive"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return df[name]
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Deletes what written() or bucketed() wrote for df, once nothing will read it again."""
    if hasattr(df, "_table"):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
    jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that numpy works on at a time, about: its temporary arrays are many times as large.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `size` bytes together, a longer text alone."""
    length = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            length += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(length), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def trimmed() -> None:
    """Gives memory that earlier tasks of this Python worker have used back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function from batch to batch, for slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in batches:
            for part in slices(batch):
                yield fn(part)
        trimmed()

    return df.mapInArrow(run, schema)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column, nulls as empty; offsets has one entry more than rows."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def texts(column: pa.Array) -> list[str]:
    """The strings of a column, nulls as empty."""
    return [t or "" for t in column.to_pylist()]


def crc_fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5, null for a null doc_id; 0 marks the held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_fold(doc_id) == 0, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    return F.coalesce(crc_fold(doc_id) != 0, F.lit(False))


def crc_fold_py(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply rounds), in place on uint64."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
