"""Embedding whitening by shifted CholeskyQR.

The fit list is each distinct vector of whole numbers once (entries become floor(scale * c)). Its rows, less their mean, are the
rows of a tall matrix A, which no one task ever holds: a pass over the list sums Gram matrices (width x width, one a task),
and the driver factors the sum. The first factor R1 is the Cholesky factor of A'A + sI with the published shift s, so that it
exists however ill-conditioned A is; each later pass orthogonalises the rows further through triangular solves with the
factors so far and gives another, until the rows' Gram matrix is the identity. The product R = Rk ... R2 R1 has the singular
values and right singular vectors of A, from which come variances and components. Working through R instead of the covariance
keeps components of small variance right to double precision.

Counts, sums and deviations are exact whole numbers; sums of Gram matrices may differ in their last bits with the partitioning.

Edge cases: rows whose vector is null or has a null, NaN or infinite entry are left out; a vector shorter than the longest is filled with
zeros; repeated rows count once in the fit list and each give their rows; components are at most as many as the width; one
without variance has null for `whitened`, 0 for `explained`, and no part in `identity_error`; `deviation` is null where it doesn't fit a long;
an empty table gives an empty table; entries so large that n times one doesn't fit a double exactly stop the job. Ids may be null; extra
columns are ignored. The width squared is what a task and the driver hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ._common import materialize
from ._vectors import EXACT, is_whole, largest, matrix, whole_entries

PASSES = 6  # bound on passes; three settle a matrix of full rank
UNIT = 2.0**-53


@dataclass
class Whitening:
    """What a fit knows: the number of distinct vectors and their sums, components as rows, variances, and its own error."""

    n: int
    width: int
    bound: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float
    error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean: one rounding, of a quotient of exact numbers."""
        return (self.n * x - self.sums) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on each component, over the root of its variance; NaN where there is none."""
        deviation = np.where(self.variances > 0, np.sqrt(self.variances), np.nan)
        return self.centred(x) @ self.components.T / deviation

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - sums) squared of each row; None where it doesn't fit a long."""
        d = self.n * x - self.sums
        if (2 * self.n * self.bound) ** 2 * max(1, self.width) < 2**63:
            return (d * d).sum(axis=1).tolist()
        exact = (d.astype(object) ** 2).sum(axis=1) if self.width else np.zeros(len(d), object)
        return [int(v) if v < 2**63 else None for v in exact]


def solve_right(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a times the inverse of the upper triangular r, by substitution, a column at a time."""
    q = np.empty_like(a)
    for j in range(r.shape[0]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _summed(fit_list: DataFrame, rows_of, height: int, width: int) -> np.ndarray:
    """The sum over tasks of a height x width matrix that rows_of(x) gives for each batch. Its rows are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if batch.num_rows:
                part = rows_of(matrix(batch.column(0), width))
                sums = part if sums is None else sums + part
        if sums is not None:
            flat = pa.array(sums.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height), pa.int32()), pa.ListArray.from_arrays(np.arange(height + 1, dtype=np.int32) * width, flat)], names=["i", "v"])

    kind = "double" if rows_of is not _column_sums else "long"
    cells = fit_list.select("x").mapInArrow(run, f"i int, v array<{kind}>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros((height, width), np.float64 if kind == "double" else np.int64)
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # height x width numbers
        out[r["i"], r["j"]] = r["v"]
    return out


def _column_sums(x: np.ndarray) -> np.ndarray:
    return x.sum(axis=0, keepdims=True)


def _factor(gram: np.ndarray, n: int, width: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of the Gram matrix, with the shift of shifted CholeskyQR where it is asked for or needed."""
    shift = 11 * (n * width + width * (width + 1)) * UNIT * float(np.trace(gram))
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(gram + max(shift, 1e-300) * np.eye(width)).T
        except np.linalg.LinAlgError:
            shift *= 10


def fit(fit_list: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of fit_list(x array<long>), a table at rest of distinct vectors; None if it is empty."""
    n, width, bound = fit_list.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(largest(F.col("x")))).first()
    if not n:
        return None
    if n * bound * 2 >= EXACT:
        raise ValueError(f"{n} vectors with entries up to {bound}: sums aren't exact as doubles")
    if not width:
        return Whitening(n, 0, 0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    model = Whitening(n, width, bound, _summed(fit_list, _column_sums, 1, width)[0], np.zeros((0, width)), np.zeros(0), 0.0)
    factors: list[np.ndarray] = []

    def gram(x: np.ndarray) -> np.ndarray:
        q = model.centred(x)
        for r in factors:
            q = solve_right(q, r)
        return q.T @ q

    whole = np.eye(width)
    for i in range(PASSES):
        g = _summed(fit_list, gram, width, width)
        if i == 0 and not np.trace(g) > 0:
            break  # one vector only
        r = _factor(g, n, width, shifted=i == 0)
        whole = r @ whole
        if i and np.abs(g - np.eye(width)).max() < 1e-12:
            break
        if i >= 3 and np.linalg.eigvalsh(g)[0] < 0.5:
            break  # directions without variance never become orthonormal; the others are by now
        factors.append(r)
    else:
        i = PASSES
    values, rows = (np.zeros(width), np.eye(width)) if not factors else np.linalg.svd(whole)[1:]
    k = min(components, width)
    variances = values**2 / n
    floor = (variances[0] if len(variances) else 0.0) * (width * 1e-14)
    kept = np.where(variances > floor, variances, 0.0)
    model.components, model.variances, model.total = rows[:k], kept[:k], float(variances.sum())
    model.error = _identity_error(fit_list, model)
    return model


def _identity_error(fit_list: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity, by one more pass."""
    good = np.flatnonzero(model.variances > 0)
    if not len(good):
        return None

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.zeros((len(x), model.width))
        w[:, : len(good)] = model.project(x)[:, good]
        return np.concatenate([w.T @ w, w.sum(axis=0, keepdims=True)])

    sums = _summed(fit_list, moments, model.width + 1, model.width) / model.n
    mean = sums[-1, : len(good)]
    return float(np.abs(sums[: len(good), : len(good)] - np.outer(mean, mean) - np.eye(len(good))).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error: a row for each whole vector and component."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(is_whole(F.col("vec"))).select("id", whole_entries(F.col("vec"), scale).alias("x"))
    schema = StructType([
        narrow.schema["id"], StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType()),
    ])
    width = narrow.agg(F.max(F.size("x"))).first()[0] or 0
    narrow = narrow.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    model = fit(materialize(narrow.select("x").dropDuplicates(["x"]), "whitening"), components)
    if model is None or not model.width:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    k = len(model.variances)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few rows of the width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        share = [float(v / m.total) if m.total else 0.0 for v in m.variances]
        for batch in batches:
            x, rows = matrix(batch.column(1), m.width), batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m.n)),
                pa.array([d for d in m.deviations(x) for _ in range(k)], pa.int64()), pa.array(m.project(x).ravel(), from_pandas=True),
                pa.array(share * rows, pa.float64()), pa.array([m.error] * (rows * k), pa.float64()),
            ], names=[f.name for f in schema])

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
