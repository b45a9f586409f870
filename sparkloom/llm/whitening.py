"""Embedding whitening by the singular values of the centred rows.

Entries become whole numbers, so sums and deviations are exact. The centred
rows go through MLlib's ``RowMatrix.computeSVD``; only the matrix of the
dimensions, never rows, reaches the driver. With the divisor n an eigenvalue
of the covariance is a singular value squared over n. The total variance does
not come from the singular values but from the exact deviations of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Beyond this many units an entry counts as that much, so that whole numbers stay exact in doubles.
MOST = 1 << 52

SCHEMA = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whole_entries(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, x)`` with x the whole numbers of every row whose vector is there and has finite entries only."""
    v = F.col(vector).cast("array<double>")
    finite = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))

    def whole(c: Column) -> Column:
        return F.floor(F.least(F.greatest(c * F.lit(float(SCALE)), F.lit(-float(MOST))), F.lit(float(MOST)))) + F.lit(SHIFT)

    return vectors.where(finite).select(F.col(key), F.transform(v, whole).alias("x"))


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per remaining row of ``vectors`` and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows without a vector, or with a null, NaN or infinite entry, are dropped.
    Null ids and repeated rows are rows of their own. A vector shorter than the
    longest counts as 0 in the dimensions that it lacks. Components whose
    singular value is not above 1e-9 of the largest can't be whitened and are
    left out, so equal vectors, a single one or none give no rows. ``deviation``
    is null beyond 38 digits. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = whole_entries(vectors, key, vector)
    kind = vectors.schema[key].dataType.simpleString()
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    none = spark.createDataFrame([], f"`{key}` {kind}, {SCHEMA}")
    if not n or not dims:
        return none
    fill = F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dims) - F.size("x"))
    rows = rows.withColumn("x", F.concat("x", fill))
    by_dim = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high"))
    stats = by_dim.orderBy("i").collect()  # a row per dimension
    mean = [divmod(int(r["s"]), n) for r in stats]  # S = n * whole + rest
    wide = max(max(r["high"] - w, w - r["low"]) for r, (w, _) in zip(stats, mean)) + 1

    whole, part = F.array(*[F.lit(w).cast("long") for w, _ in mean]), F.array(*[F.lit(r / n) for _, r in mean])
    centred = F.zip_with(F.zip_with("x", whole, lambda x, w: (x - w).cast("double")), part, lambda x, p: x - p)
    matrix = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("v")), "v")
    if wide == 1 and not any(r for _, r in mean):
        return none  # all vectors are equal
    # for all dimensions the decomposition is LAPACK's, exact to double precision; for a few it is an iteration that stops earlier
    svd = RowMatrix(matrix, n, dims).computeSVD(dims, computeU=False)
    values = np.array(svd.s.toArray())[:components]
    k = len(values)
    if not k:
        return none
    eigen, axes = values**2 / n, svd.V.toArray()[:, :k]
    scaled = axes / np.sqrt(eigen)

    w_, r_ = np.array([w for w, _ in mean], np.int64), [r for _, r in mean]
    exact64 = (n * wide + n) ** 2 * dims < 1 << 63
    kinds = {"x": None, "w": "array<double>", "deviation": "long" if exact64 else "string"}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.array(r_, np.int64 if exact64 else object)
        share = np.array([r / n for r in r_])
        for part in parts:
            x = part.column(1).flatten().to_numpy().reshape(-1, dims) - w_
            far = x * n - rest if exact64 else x.astype(object) * n - rest
            total = (far * far).sum(axis=1)
            out = (x - share) @ scaled
            deviation = pa.array(total, pa.int64()) if exact64 else pa.array([str(t) for t in total], pa.string())
            nested = pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * k, k, dtype=np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), nested, deviation], names=[key, "w", "deviation"])

    made = rows.mapInArrow(run, f"`{key}` {kind}, w {kinds['w']}, deviation {kinds['deviation']}")
    made = stored(made.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)")))
    sums = made.agg(F.sum("deviation").alias("total"), *[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()
    trace = float(Fraction(int(sums["total"]), n**3)) if sums["total"] is not None else float("nan")
    off = [F.get("w", F.lit(i)) - F.lit(sums[f"m{i}"]) for i in range(k)]
    cov = made.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i + 1))
    explained = F.array(*[F.lit(float(e) / trace) for e in eigen])
    told = made.select(key, "deviation", F.posexplode("w").alias("place", "whitened"))
    return told.select(
        key, (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
