"""A stored frame with keyed merges: data files by key range, and a manifest a version that names them.

`_versions/<n>.json` lists the files of version n with the range of keys and the rows of each, and the chunks taken
in so far. A version comes to be by one rename that fails if the name is taken, so it is there whole or not at
all: a job that dies before leaves files that no manifest names (`vacuum` removes them), and of two writers one
fails and may try again. A merge reads and rewrites only files whose range has an incoming key; the others keep
their names. A chunk that was taken in before changes nothing.

Files are ordered by the text of their keys and their ranges do not overlap, so an incoming key finds its file by
binary search among the lower ends, and readers prune files by key. The manifest is read by the driver: its size
is that of the file list (a gigabyte a file: 100,000 files at 100 TB), not of the rows.

Cases: rows with a null in a key cannot be matched and are refused, with an error. Incoming
rows must have one row a key (fold them first). An empty chunk makes a version without new files. Columns may
have any names but those of the store's own (FILE, KEY, STATE).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.upsert import merged

KEY, FILE, STATE = "_key", "_file", "state"
#: Rows a file, about.
ROWS = 1_000_000


class Conflict(RuntimeError):
    """Another writer has made the version; read again and retry."""


@dataclass
class Version:
    number: int
    #: Path below the store, lowest and highest key, rows; by key.
    files: list[dict[str, Any]] = field(default_factory=list)
    chunks: list[str] = field(default_factory=list)
    #: Rows of the last merge by state.
    states: dict[str, int] = field(default_factory=dict)


def key_of(keys: list[str]) -> Column:
    """The text by which rows are ordered: keys of one prefix lie together."""
    return F.concat_ws("\x00", *(F.col(k).cast("string") for k in keys))


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], rules: dict[str, str | Column], rows: int = ROWS):
        """schema: of keys and values, as DDL; rules: for each value the rule of upsert.merged."""
        self.spark, self.path, self.schema, self.keys, self.rules, self.rows = spark, path.rstrip("/"), schema, keys, rules, rows
        self.columns = [*keys, *rules]
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]

    def version(self, number: int | None = None) -> Version:
        """The latest version or the given one; version 0 has no rows."""
        known = sorted(int(n.removesuffix(".json")) for n in self._names("_versions") if n.endswith(".json") and not n.startswith("."))
        number = (known[-1] if known else 0) if number is None else number
        if number == 0:
            return Version(0)
        if number not in known:
            raise ValueError(f"no version {number}")
        return Version(**json.loads(self._text(f"_versions/{number:020d}.json")))

    def _commit(self, version: Version) -> None:
        """Writes the manifest beside its place and renames it there, which fails if another one has come first."""
        jvm, draft = self._jvm, f"_versions/.{uuid.uuid4().hex}"
        out = self._fs.create(self._at(draft), False)
        try:
            out.write(json.dumps(vars(version)).encode())
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._at(draft), self._at(f"_versions/{version.number:020d}.json"), never)
        except Py4JJavaError as e:
            self._fs.delete(self._at(draft), False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version.number} of {self.path} exists") from e
            raise

    def _rows_of(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f['path']}" for f in files))

    def read(self, number: int | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
        """All rows of a version, or those of the files that may hold keys from low to high (texts of keys)."""
        files = self.version(number).files
        return self._rows_of([f for f in files if (low is None or f["high"] >= low) and (high is None or f["low"] <= high)])

    def read_groups(self, groups: DataFrame, keys: list[str]) -> DataFrame:
        """The rows whose first keys (of self.keys, in order) are in groups, from the files that may hold them."""
        files = self.version().files
        if not files:
            return self._rows_of([])
        lows = np.array([f["low"] for f in files], dtype=object)

        def span(first: pd.Series) -> pd.Series:
            begin = np.maximum(np.searchsorted(lows, (first + "\x00").to_numpy(object), "right") - 1, 0)
            end = np.searchsorted(lows, (first + "\x01").to_numpy(object), "left")
            return pd.Series(begin * len(lows) + np.maximum(end, begin + 1) - 1)

        spans = groups.select(F.pandas_udf(span, "long")(key_of(keys)).alias("span")).distinct().collect()  # two a file at most
        wanted = {i for r in spans for i in range(r["span"] // len(lows), r["span"] % len(lows) + 1)}
        return self._rows_of([f for i, f in enumerate(files) if i in wanted]).join(groups.select(*keys).distinct(), keys, "left_semi")

    def read_states(self) -> DataFrame:
        """The rows of the latest version, each with what its last merge made of it: matched, created or kept."""
        now = self.version()
        late = [f for f in now.files if f["path"].startswith(f"data/{now.number:020d}-")]
        rest = [f for f in now.files if f not in late]
        new = self.spark.read.schema(f"{self.schema}, {STATE} string").parquet(*(f"{self.path}/{f['path']}" for f in late)) if late else self._rows_of([]).withColumn(STATE, F.lit(""))
        return new.unionByName(self._rows_of(rest).withColumn(STATE, F.lit("kept"))) if rest else new

    def merge(self, incoming: DataFrame, chunk: str) -> Version:
        """Takes a chunk in: a version more, or the latest one if it has the chunk already."""
        now = self.version()
        if chunk in now.chunks:
            return now
        lows = np.array([f["low"] for f in now.files], dtype=object)

        def place(keys: pd.Series) -> pd.Series:
            return pd.Series(np.maximum(np.searchsorted(lows, keys.to_numpy(object), "right") - 1, 0).astype(np.int32))

        find = F.pandas_udf(place, "int")
        home = find(key_of(self.keys)) if len(lows) else F.lit(0)
        staged = f"{self.path}/data/{now.number + 1:020d}-{uuid.uuid4().hex}"
        # Written, so that what makes the chunk runs once.
        incoming.select(*self.columns).withColumn(FILE, home).write.parquet(staged)
        dealt = self.spark.read.parquet(staged)
        lost = F.count_if(F.concat(*(F.col(k).cast("string") for k in self.keys)).isNull())
        found = dealt.groupBy(FILE).agg(F.count(F.lit(1)).alias("rows"), lost.alias("lost")).collect()  # one row a file at most
        if any(r["lost"] for r in found):
            self._fs.delete(self._at(staged.removeprefix(self.path + "/")), True)
            raise ValueError(f"{sum(r['lost'] for r in found)} rows have a null in {self.keys}")
        touched = sorted(r[FILE] for r in found)
        old = [now.files[i] for i in touched if i < len(now.files)]
        after = merged(self._rows_of(old), dealt, self.keys, self.rules, {FILE: "newest"} if len(lows) else {})
        # Rows that no incoming row met find their file by their own key.
        where = F.coalesce(F.col(FILE), find(key_of(self.keys))) if len(lows) else F.lit(0)
        after = after.withColumn(KEY, key_of(self.keys)).withColumn(FILE, where)
        folder = f"data/{now.number + 1:020d}-{uuid.uuid4().hex}"
        size = sum(f["rows"] for f in old) + sum(r["rows"] for r in found)
        # Ranges within a file of before: a range never spans a file that stays as it is.
        spread = after.repartitionByRange(max(1, -(-size // self.rows)), FILE, KEY).sortWithinPartitions(FILE, KEY)
        spread.write.option("maxRecordsPerFile", 2 * self.rows).partitionBy(FILE).parquet(f"{self.path}/{folder}")
        self._fs.delete(self._at(staged.removeprefix(self.path + "/")), True)
        made, states = self._made(folder)
        files = [f for i, f in enumerate(now.files) if i not in set(touched)] + made
        version = Version(now.number + 1, sorted(files, key=lambda f: f["low"]), [*now.chunks, chunk], states)
        self._commit(version)
        return version

    def _made(self, folder: str) -> tuple[list[dict], dict[str, int]]:
        if not any(n.startswith(f"{FILE}=") for n in self._names(folder)):
            return [], {}
        rows = self.spark.read.parquet(f"{self.path}/{folder}").withColumn("path", F.input_file_name())
        found = rows.groupBy("path", STATE).agg(F.min(KEY).alias("low"), F.max(KEY).alias("high"), F.count(F.lit(1)).alias("rows")).collect()  # three rows a file
        files: dict[str, dict] = {}
        states: dict[str, int] = {}
        for r in found:
            states[r[STATE]] = states.get(r[STATE], 0) + r["rows"]
            own = files.setdefault(r["path"], {"path": folder + r["path"].split(folder, 1)[1], "low": r["low"], "high": r["high"], "rows": 0})
            own["low"], own["high"], own["rows"] = min(own["low"], r["low"]), max(own["high"], r["high"]), own["rows"] + r["rows"]
        return list(files.values()), states

    def vacuum(self) -> int:
        """Removes the folders of data that no version names; not while a writer is at work. How many went."""
        known = {f["path"].split("/")[1] for n in self._names("_versions") if n.endswith(".json") for f in self.version(int(n.removesuffix(".json"))).files}
        gone = [n for n in self._names("data") if n not in known]
        for n in gone:
            self._fs.delete(self._at(f"data/{n}"), True)
        return len(gone)
