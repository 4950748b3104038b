"""Whitening of embeddings: exact integer centring, a Gramian by MLlib's RowMatrix, a local eigendecomposition.

An entry c becomes the integer floor(64 c) + 1,000,000. Sums by dimension are exact, so that n x - S, n times a row's
distance from the mean, is exact too: rows are centred before anything is multiplied. The covariance is the Gramian of the
centred rows over n; only its d x d entries reach the driver. Its unit eigenvectors, by falling eigenvalue and divided by
the eigenvalue's root, are broadcast (d x components) and applied to batches of rows. The whitened rows' own covariance is
taken the same way, centred again, and compared with the identity.

Cases: vectors that are null or hold null, NaN, an infinity or an entry beyond 2**46 in size (whose integer isn't safe in a
long) are left out; shorter vectors are taken as filled up with zeros; a null id is a value like others; repeated rows
count and are returned each; a direction without variance (an eigenvalue below d * 2**-52 of the largest) has whitened 0
and explained as computed, and doesn't count in identity_error; an empty table and empty vectors give no rows; other
columns don't matter. The deviation is a decimal(38, 0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize

SCALE, SHIFT = 64, 1_000_000
#: Entries of a larger size count as not finite.
LARGEST = float(1 << 46)


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """-> id, x: the clean rows' entries as long."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    clean = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    return vectors.filter(clean).select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _sums(rows: DataFrame, width: int) -> list[int]:
    """Exact sums by dimension; entries that a row hasn't are zeros, whose integer is SHIFT."""
    schema = pa.schema([("dim", pa.int32()), ("s", pa.int64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            total += _matrix(b.column(0), width).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], schema=schema)

    sums = rows.select("x").mapInArrow(partial, "dim int, s long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["dim"]: int(r["s"]) for r in sums.collect()}  # a row for each dimension
    return [found[k] for k in range(width)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of width entries."""
    n, lengths = len(column), column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    if (lengths == width).all():
        return flat.reshape(n, width)
    out = np.full((n, width), SHIFT, np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _row_matrix(rows: DataFrame, column: str) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v"))


def _covariance(rows: DataFrame, column: str, n: int, centre: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """By RowMatrix over the centred rows: partial sums of outer products in the tasks, added up as a tree, over n."""

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_lists(centre(_matrix(b.column(0), width)))], names=["c"])

    return _row_matrix(rows.select(column).mapInArrow(centred, "c array<double>"), "c").computeGramianMatrix().toArray() / n


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, dtype=float).reshape(-1)))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 32) -> DataFrame:
    """-> id, n, deviation (sum of (n x - S)**2), whitened and explained (arrays by component, most of them), identity_error."""
    spark = vectors.sparkSession
    bound_batches(spark, 4_000)
    schema = "id {}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = materialize(integers(vectors, id_col, vec_col))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not width:
        return spark.createDataFrame([], schema.format(kind)).withColumnRenamed("id", id_col)
    sums = _sums(rows, width)
    # n x - S = n (x - S // n) - S % n: the integers stay as small as the distances themselves
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)

    def centre(x: np.ndarray) -> np.ndarray:
        return ((x - whole) * float(n) - rest) / n

    cov = _covariance(rows, "x", n, centre, width)
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    k, trace = min(most, width), float(np.trace(cov))
    real = values[:k] > max(values[0], 0) * width * 2.0**-52
    weights = np.where(real, axes[:, :k] / np.sqrt(np.where(real, values[:k], 1.0)), 0.0)
    shared = spark.sparkContext.broadcast(weights)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = _matrix(pa.array(f["x"], pa.list_(pa.int64())), width)
            yield pd.DataFrame({"id": f["id"], "deviation": _squares(x - whole, rest, n), "whitened": list(centre(x) @ shared.value)})

    done = materialize(rows.mapInPandas(apply, f"id {kind}, deviation string, whitened array<double>"))
    mean = _row_matrix(done, "whitened").computeColumnSummaryStatistics().mean()
    off = np.abs(_covariance(done, "whitened", n, lambda w: w - mean, k) - np.eye(k))[np.ix_(real, real)]
    explained = [float(v / trace) if trace > 0 else 0.0 for v in values[:k]]
    own = [F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened"]
    return done.select(*own, F.array(*[F.lit(e) for e in explained]).alias("explained"), F.lit(float(off.max(initial=0.0))).alias("identity_error"))


def _squares(x: np.ndarray, rest: np.ndarray, n: int) -> list[str]:
    """Sums of (n x - rest)**2 over each row, exact at any size."""
    if not len(x):
        return []
    bound = n * (float(np.abs(x).max()) + 1)
    if bound**2 * x.shape[1] < 2.0**62:
        d = n * x - rest
        return [str(v) for v in (d * d).sum(axis=1).tolist()]
    d = n * x.astype(object) - rest.astype(object)
    return [str(v) for v in (d * d).sum(axis=1)]


def whitening_report(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 32) -> DataFrame:
    """One row for each vector and component; the deviation as long (an error where it is beyond one)."""
    each = whiten(vectors, id_col, vec_col, most).select("*", F.posexplode("whitened").alias("_k", "_w"))
    return each.select(id_col, (F.col("_k") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"), F.col("_w").alias("whitened"), F.element_at("explained", F.col("_k") + 1).alias("explained"), "identity_error")
