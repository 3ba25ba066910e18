"""Centroid clustering of integer vectors with Elkan's bounds.

Every vector carries an upper bound of its distance to its own centroid and k lower bounds, of its distances to
all. When centroids move, the bounds are moved as far; a centroid is tried only if neither its lower bound nor
half its distance to the vector's own centroid rules it out. Bounds are doubles, rounded away from the
truth by SLACK (upper ones up, lower ones down), and rule a centroid out only if they are strictly
greater, so no tie is lost: what decides is always the exact squared distance of integers. Each round is one
pass (mapInArrow) over the vectors, written to the shared folder with its bounds; centroids are exact sums
by cluster, and k rows of them reach the driver.

Cases: rows whose vector is null, of another length, or holds a null or a non-finite component take no part.
Rows that share a vec_id are vectors of their own; to begin with such rows are ordered by their components,
and rows without vec_id come last. Fewer than k vectors make as many clusters. A component is at most LARGEST
in size after scaling, so that no squared distance overflows a long; a larger one raises an error, as a long
cannot hold its distance. An empty table gives an empty result. Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, own, written

#: Relative room of a bound for the rounding of a root, a sum or a difference: far more than they need.
SLACK = 1e-12
LARGEST = 1 << 28
SEED = "1:"


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - SLACK), 0.0)


def usable(vector: Column, size: int | None = None) -> Column:
    """The vector has `size` components, if given, and none of them is null or non-finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fits = vector.isNotNull() & ~bad
    return fits & (F.size(vector) == size) if size is not None else fits


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * c) of each component, as a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(factor))))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def reassigned(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
    """The cluster of each row of x: the nearest centroid, ties to the smaller number. Takes valid bounds, leaves
    tight ones in place; also returns how many distances were computed. A negative cluster has no bounds yet."""
    k, n = len(centroids), len(x)
    between = np.sqrt(np.array([squared(centroids, c) for c in centroids], np.float64).reshape(k, k))
    half = down(between / 2)
    np.fill_diagonal(half, np.inf)
    near = half.min(axis=1) if k > 1 else np.full(k, np.inf)
    exact, computed = np.full(n, -1, np.int64), 0  # squared distance to the own centroid, where known
    fresh = np.flatnonzero(cluster < 0)
    if len(fresh):
        exact[fresh] = squared(x[fresh], centroids[0])
        computed += len(fresh)
        cluster[fresh] = 0
        upper[fresh] = up(np.sqrt(exact[fresh]))
        lower[fresh] = 0.0
        lower[fresh, 0] = down(np.sqrt(exact[fresh]))
    open_ = np.flatnonzero(upper >= near[cluster])
    for j in range(k):
        if not len(open_):
            break
        may = lambda rows, j=j: rows[(cluster[rows] != j) & (upper[rows] >= lower[rows, j]) & (upper[rows] >= half[cluster[rows], j])]
        rows = may(open_)
        loose = rows[exact[rows] < 0]
        if len(loose):  # the upper bound is made tight before any other distance is computed
            for c in np.unique(cluster[loose]):
                own_rows = loose[cluster[loose] == c]
                exact[own_rows] = squared(x[own_rows], centroids[c])
                lower[own_rows, c] = down(np.sqrt(exact[own_rows]))
            computed += len(loose)
            upper[loose] = up(np.sqrt(exact[loose]))
            rows = may(rows)
        d = squared(x[rows], centroids[j])
        computed += len(rows)
        lower[rows, j] = down(np.sqrt(d))
        better = (d < exact[rows]) | ((d == exact[rows]) & (j < cluster[rows]))
        won = rows[better]
        cluster[won], exact[won] = j, d[better]
        upper[won] = up(np.sqrt(d[better]))
    return cluster, computed


def moved(upper: np.ndarray, lower: np.ndarray, cluster: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """The bounds that hold after the centroids have gone from before to after."""
    way = up(np.sqrt(((after - before) ** 2).sum(axis=1, dtype=np.int64)))
    upper[:] = up(upper + way[cluster])
    lower[:] = down(lower - way)


STATE = "vec_id long, x array<long>, cluster int, upper double, lower array<double>"


def assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The state after one round of assignments; before: the centroids that the state's bounds refer to."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), size)
            if before is None:
                cluster, upper, lower = np.full(len(x), -1, np.int64), np.zeros(len(x)), np.zeros((len(x), k))
            else:
                cluster, upper = batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy().copy()
                lower = matrix(batch.column("lower"), k).copy()
                moved(upper, lower, cluster, before, centroids)
            cluster, _ = reassigned(x, centroids, cluster, upper, lower)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "x": batch.column("x"), "cluster": pa.array(cluster.astype(np.int32)), "upper": pa.array(upper), "lower": bounds})

    return state.mapInArrow(run, STATE)


def sums_of(state: DataFrame, size: int) -> dict[int, tuple[int, list[int]]]:
    """Rows and exact component sums of each cluster; every task sends k rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, cluster = matrix(batch.column("x"), size), batch.column("cluster").to_numpy()
            for c in np.unique(cluster).tolist():
                own_rows = x[cluster == c]
                total[c] = total.get(c, np.zeros(size + 1, np.int64)) + np.append(own_rows.sum(axis=0), len(own_rows))
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(list(total), pa.int32()), "sums": pa.array([s.tolist() for s in total.values()], pa.list_(pa.int64()))})

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, sums array<long>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size + 1)]
    return {r[0]: (int(r[-1]), [int(s) for s in r[1:-1]]) for r in parts.groupBy("cluster").agg(*exact).collect()}  # k rows


def first_centroids(vectors: DataFrame, k: int, seed: str = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of the seed and their vec_id, as rows."""
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64)


def clusters(embeddings: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, factor: int = 64, vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each usable vector."""
    spark = embeddings.sparkSession
    raw = embeddings.select(own(embeddings, "vec_id").cast("long").alias("vec_id"), own(embeddings, vector).alias("v"))
    raw = raw.filter(usable(F.col("v"), size))
    fits = F.forall("x", lambda c: F.abs(c) < LARGEST)
    x = F.when(fits, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("a component is too large for a distance in a long, in vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))))
    vectors = written(raw.select("vec_id", scaled(F.col("v"), factor).alias("x")).select("vec_id", x.cast("array<long>").alias("x")), "vectors")
    centroids = first_centroids(vectors, k)
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        discard(vectors)
        return spark.createDataFrame([], columns)
    state = written(assigned(vectors, centroids, None), "bounds")
    discard(vectors)
    for _ in range(rounds):
        before, centroids = centroids, centroids.copy()
        for c, (n, sums) in sums_of(state, size).items():
            centroids[c] = [s // n for s in sums]
        after = written(assigned(state, centroids, before), "bounds")
        discard(state)
        state = after

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": batch.column("cluster"), "distance": pa.array(squared(matrix(batch.column("x"), size), centroids[cluster]))})

    found = written(state.select("vec_id", "x", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long"), "clusters")
    discard(state)
    totals = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = lambda values, kind: F.get(F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>"), F.col("cluster"))
    return found.select(
        "vec_id", "cluster", "distance", of_cluster([totals.get(c, 0) for c in range(len(names))], "long").alias("cluster_inertia"), F.lit(sum(totals.values())).cast("long").alias("inertia"), of_cluster(names, "string").alias("centroid_sha256")
    )
