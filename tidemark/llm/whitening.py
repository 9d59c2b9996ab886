"""Whitened embeddings from a two-pass covariance.

Entries become integers, so the first pass has exact sums and an exact mean. The
second pass sums centred outer products, a matrix product for every batch, and
merges the partial sums in a tree. The driver decomposes one matrix of dims x dims
(LAPACK's symmetric solver) and sends the projection back. A third pass measures
the covariance of what comes out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .vectors import element_type, matrix, usable, usual_length

#: An entry c becomes floor(SCALE * c) + SHIFT (fixed values).
SCALE, SHIFT = 64, 1_000_000
#: Vectors that are computed with at once.
STEP = 4096
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Centre:
    """Exact mean of integer vectors: ``whole`` + ``rest`` / ``n`` in every dimension, 0 <= rest < n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def exact(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums) ** 2 for every row; None where it doesn't fit a long."""
        near = x - self.whole
        most = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] <= _LONG:
            return ((self.n * near - self.rest) ** 2).sum(axis=1).tolist()
        sums = ((near.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1).tolist()
        return [s if s <= _LONG else None for s in sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n


def integers(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.floor(SCALE * matrix(column, kind)).astype(np.int64) + SHIFT


def exact_centre(rows: DataFrame, kind: np.dtype) -> Centre:
    """First pass: exact sums in two halves of 32 bits, added up as decimals."""

    def run(batches):
        n, high, low = 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                x = integers(batch.column(0).slice(at, STEP), kind)
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(len(high), dtype=np.int32)), "n": pa.array(np.full(len(high), n)), "high": pa.array(high), "low": pa.array(low)})

    parts = rows.select("vec").mapInArrow(run, "dim int, n long, high long, low long")
    sums = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), *sums).orderBy("dim").collect()  # a row for each dimension
    totals = [divmod((int(r["high"]) << 32) + int(r["low"]), r["n"]) for r in found]
    return Centre(found[0]["n"], np.array([t[0] for t in totals]), np.array([t[1] for t in totals]))


def outer_sum(rows: DataFrame, prepare, size: int) -> np.ndarray:
    """Sum of the outer products of ``prepare(batch column)``'s rows, partial sums merged in a tree."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                z = prepare(batch.column(0).slice(at, STEP))
                total += z.T @ z
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("vec").mapInArrow(run, "part binary").rdd
    return parts.treeAggregate(np.zeros((size, size)), lambda total, row: total + np.frombuffer(row[0]).reshape(size, size), np.add)


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 32) -> DataFrame:
    """Project integer vectors on the unit eigenvectors of their covariance, over the deviation along each.

    Returns, for each usable row and component: the key, component (from 1, by falling
    eigenvalue), n, deviation (exact, of the row in all dimensions; null if it doesn't fit
    a long), whitened, explained (share of the trace) and identity_error, measured on all
    that is returned. Rows are left out whose vector is null or empty, holds null or
    non-finite entries or entries of 2**56 and over, or has another length than most
    have (of equally frequent lengths the smaller one stays). Repeated rows and null keys
    count as rows of their own. Components without variance are left out: equal vectors, a
    single vector and an empty table give no rows. Other columns play no part.
    """
    spark, kind = vectors.sparkSession, element_type(vectors, column)
    schema = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    every = stored(usable(vectors, key, column), "vectors")
    dims = usual_length(every)
    if not dims:
        return spark.createDataFrame([], schema)
    rows = every.where(F.col("dims") == dims).select("id", "vec")
    centre = exact_centre(rows, kind)
    covariance = outer_sum(rows, lambda c: centre.centred(integers(c, kind)), dims) / centre.n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(components, int((values > max(values[0], 0) * dims * np.finfo(float).eps).sum()))
    if not count:
        return spark.createDataFrame([], schema)
    axes = axes[:, :count] * np.sign(axes[np.abs(axes[:, :count]).argmax(axis=0), np.arange(count)])  # one of either sign
    projection = spark.sparkContext.broadcast(axes / np.sqrt(values[:count]))
    explained = values[:count] / np.trace(covariance)

    # what is projected has mean zero by construction, up to rounding
    error = float(np.abs(outer_sum(rows, lambda c: centre.centred(integers(c, kind)) @ projection.value, count) / centre.n - np.eye(count)).max())

    def run(batches):
        names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                ids, x = batch.column(0).slice(at, STEP), integers(batch.column(1).slice(at, STEP), kind)
                each = pa.array(np.repeat(np.arange(len(x)), count))
                out = [ids.take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * count, centre.n))]
                out += [pa.array(centre.exact(x), pa.int64()).take(each), pa.array((centre.centred(x) @ projection.value).ravel())]
                out += [pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * count, error))]
                yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(run, schema)
