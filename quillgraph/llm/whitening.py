"""PCA whitening of embeddings over the distinct vectors.

The fit list holds each different vector once. One aggregation has its size and sums; a second one, generated as
SQL, sums the centred product of every pair of dimensions (the upper triangle). Vectors are integers and are
centred on the whole part of the mean, so these sums are exact in doubles up to 2**53, whatever the order of
addition; what the fractions of the mean add is put right in exact integers on the driver, which gets one
row of d (d + 1) / 2 numbers. LAPACK (eigh) decomposes the covariance. A third aggregation over the fit list
measures how far the whitened covariance is from the identity. Nothing that grows with the rows reaches the driver.

Components whose eigenvalue is no more than RANK times the largest, as those of constant or dependent
dimensions, have no direction to scale by and are left out, so a table may have fewer components than asked
for, or none. Cases: rows whose vector is null or holds a null or a non-finite entry are left out. All vectors
that are left must have one length, else an error is raised: a covariance of vectors of different lengths has no
meaning. Repeated rows and null vec_ids keep their rows. An empty table gives an empty result. Columns other
than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.clustering import matrix, scaled, usable
from quillgraph.llm.common import discard, own, written

FACTOR, OFFSET = 64, 1_000_000
RANK = 1e-12
COLUMNS = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """centre: whole parts of the mean; rest: n times what is left of it; weights: one column a component."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    weights: np.ndarray
    explained: np.ndarray

    def project(self, z: np.ndarray) -> np.ndarray:
        return (z - self.rest / self.n) @ self.weights


def covariance(fit: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covariance, centre, rest) of the column x of fit, whose rows and component sums are given."""
    d = len(sums)
    centre = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre, strict=True)]
    # No entry is null; said so, the sums need no null checks.
    centred = fit.selectExpr(*(f"nvl(CAST(x[{i}] - {m}L AS DOUBLE), 0D) AS z{i}" for i, m in enumerate(centre)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = centred.selectExpr(*(f"sum(z{i} * z{j}) AS p{i}_{j}" for i, j in pairs)).first()
    v = np.zeros((d, d))
    for (i, j), p in zip(pairs, row, strict=True):
        v[i, j] = v[j, i] = (n * int(p) - rest[i] * rest[j]) / n**2  # whole numbers of any size, rounded once
    return v, np.array(centre, np.int64), np.array(rest, np.int64)


def decomposed(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue, `most` of them, those with no spread left out."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > RANK * max(values.max(), 0.0)]
    return values[order], vectors[:, order]


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, measured over the fit list."""
    d, k = model.weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = model.project(matrix(batch.column("x"), d) - model.centre)
            total += w.T @ w
            sums += w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(k * k + k, dtype=np.int32)), "s": pa.array(np.concatenate([total.ravel(), sums]))})

    rows = fit.select("x").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()  # k * k + k rows
    s = np.zeros(k * k + k)
    for r in rows:
        s[r["at"]] = r["s"]
    mean = s[k * k :] / model.n
    return float(np.abs(s[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def fitted(fit: DataFrame, most: int) -> Whitening | None:
    """The whitening of the column x (arrays of longs of one length) of fit; None without rows or spread."""
    shape = fit.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if not shape["n"] or not shape["high"]:
        return None
    if shape["low"] != shape["high"]:
        raise ValueError(f"vectors have from {shape['low']} to {shape['high']} entries")
    sums = [int(s) for s in fit.agg(*(F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(shape["high"]))).first()]
    v, centre, rest = covariance(fit, shape["n"], sums)
    values, vectors = decomposed(v, most)
    return Whitening(shape["n"], centre, rest, vectors / np.sqrt(values), values / np.trace(v)) if len(values) else None


def whitened(embeddings: DataFrame, most: int = 16, vector: str = "embedding") -> DataFrame:
    """COLUMNS for each usable vector and each of at most `most` components.

    deviation is the sum over dimensions of (n x - S)**2, exact, where S has the sums of the fit list.
    """
    raw = embeddings.select(own(embeddings, "vec_id").cast("long").alias("vec_id"), own(embeddings, vector).alias("v"))
    rows = raw.filter(usable(F.col("v"))).select("vec_id", F.transform(scaled(F.col("v"), FACTOR), lambda c: c + OFFSET).cast("array<long>").alias("x"))
    fit = written(rows.select("x").distinct(), "fit")
    model = fitted(fit, most)
    if model is None:
        discard(fit)
        return embeddings.sparkSession.createDataFrame([], COLUMNS)
    error, k, n = identity_error(fit, model), model.weights.shape[1], model.n
    discard(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = matrix(batch.column("x"), len(model.centre)) - model.centre
            w = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * k), pa.array(model.project(z).ravel()))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "zz": pa.array((z * z).sum(axis=1)), "zr": pa.array(z @ model.rest), "w": w})

    found = rows.mapInArrow(run, "vec_id long, zz long, zr long, w array<double>")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    # (n z - r)**2 summed is n**2 zz - 2 n zr + rr, all whole numbers.
    deviation = whole("zz") * F.expr(f"CAST({n * n} AS DECIMAL(38,0))") - whole("zr") * F.expr(f"CAST({2 * n} AS DECIMAL(38,0))") + F.expr(f"CAST({int(sum(int(r) ** 2 for r in model.rest))} AS DECIMAL(38,0))")
    shares = F.array(*(F.lit(float(e)) for e in model.explained))
    return found.select("vec_id", deviation.cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
