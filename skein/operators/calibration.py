"""Linear machines whose margins become probabilities by a sigmoid for each class, fitted on margins of rows that weren't learnt from."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import materialize
from .stored import Stored

def sigmoids(margins: DataFrame, iterations: int = 60, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """a, b by class such that 1 / (1 + exp(a * margin + b)) is the share of a class among rows of that margin.

    margins(label_idx, margins array<double>), a table at rest. Maximum likelihood with Platt's targets, (n + 1) / (n + 2) for the rows
    of a class and 1 / (n + 2) for the others, so that classes which a margin tells apart fully get finite slopes. Newton's steps of all
    classes come from one aggregate a step; a step that makes things worse is halved."""
    sizes = {r["label_idx"]: r["n"] for r in margins.groupBy("label_idx").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    n, k = sum(sizes.values()), margins.agg(F.max(F.size("margins"))).first()[0] or 0
    own = np.array([sizes.get(c, 0) for c in range(k)], float)
    high, low = (own + 1) / (own + 2), 1 / (n - own + 2)
    a, b = np.zeros(k), np.log((n - own + 1) / (own + 1))
    each = margins.select("label_idx", F.posexplode("margins").alias("c", "m"))

    def measured(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Loss, gradient and second derivatives by class."""
        pick = lambda v: F.get(F.array(*[F.lit(float(x)) for x in v]), F.col("c"))
        rows = each.select("c", "m", F.when(F.col("label_idx") == F.col("c"), pick(high)).otherwise(pick(low)).alias("t"), (pick(a) * F.col("m") + pick(b)).alias("f"))
        q = F.exp(-F.abs("f"))
        p = F.when(F.col("f") >= 0, q / (q + 1)).otherwise(F.lit(1.0) / (q + 1))
        loss = F.when(F.col("f") >= 0, F.col("t") * F.col("f")).otherwise((F.col("t") - 1) * F.col("f")) + F.log1p(q)
        rows = rows.select("c", "m", loss.alias("loss"), (F.col("t") - p).alias("g"), (p * (F.lit(1.0) - p)).alias("h"))
        out = np.zeros((k, 6))
        for r in rows.groupBy("c").agg(F.sum("loss"), F.sum(F.col("g") * F.col("m")), F.sum("g"), F.sum(F.col("h") * F.col("m") * F.col("m")), F.sum(F.col("h") * F.col("m")), F.sum("h")).collect():
            out[r[0]] = r[1:]
        return out

    now, step = measured(a, b), np.ones(k)
    for _ in range(iterations):
        _, ga, gb, haa, hab, hbb = now.T
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        det = np.where(det > 0, det, 1.0)
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        moved = (np.abs(da) + np.abs(db)) > tolerance * (1 + np.abs(a) + np.abs(b))
        if not (moved & (step > 1e-6)).any():
            break
        new = measured(a + np.where(moved, step * da, 0), b + np.where(moved, step * db, 0))
        better = moved & (new[:, 0] < now[:, 0])
        a, b = np.where(better, a + step * da, a), np.where(better, b + step * db, b)
        now = np.where(better[:, None], new, now)
        step = np.where(better, 1.0, np.where(moved, step / 2, step))
    return a, b


class Descent:
    """One machine's way down by limited-memory quasi-Newton steps: `trial` is the point to be measured next, `tell` takes what was
    measured there. A step that doesn't lower the loss enough is halved."""

    def __init__(self, size: int, memory: int = 8):
        self.x, self.loss, self.gradient = np.zeros(size), math.inf, np.zeros(size)
        self.step, self.t, self.pairs, self.memory, self.done = np.zeros(size), 1.0, [], memory, False

    @property
    def trial(self) -> np.ndarray:
        return self.x + self.t * self.step

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        slope = float(self.gradient @ self.step)
        if loss > self.loss + 1e-4 * self.t * slope:
            self.t /= 2
            self.done = self.t < 1e-6
            return
        s, y = self.trial - self.x, gradient - self.gradient
        if float(s @ y) > 1e-12:
            self.pairs = [*self.pairs, (s, y)][-self.memory :]
        self.done = math.isfinite(self.loss) and self.loss - loss < 1e-7 * (1 + abs(loss))
        self.x, self.loss, self.gradient = self.trial, loss, gradient
        q, alphas = gradient.copy(), []
        for s, y in reversed(self.pairs):
            alphas.append(float(s @ q) / float(s @ y))
            q -= alphas[-1] * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), alpha in zip(self.pairs, reversed(alphas), strict=True):
            q += (alpha - float(y @ q) / float(s @ y)) * s
        self.step, self.t = -q, 1.0 if self.pairs else 1 / max(1.0, float(np.linalg.norm(q)))
        if float(self.step @ gradient) >= 0:
            self.step, self.pairs = -gradient, []
            self.done = self.done or not gradient.any()


class CalibratedMachines(Estimator):
    """One linear machine a class against the rest, with penalty `c` on errors (1 / (c * sum of weights) on coefficients), and its sigmoid.

    The machines of all classes, on all rows and without each fold, learn side by side: a step of all of them is one pass over the rows.
    The hinge is rounded off within `corner` of where it begins, so that it has a gradient everywhere."""

    def __init__(self, column: str, c: float = 1.0, iterations: int = 40, folds: int = 5, corner: float = 0.05):
        super().__init__()
        self.column, self.c, self.iterations, self.folds, self.corner = column, c, iterations, folds, corner

    def _fit(self, df: DataFrame) -> CalibratedModel:
        vec = vector_to_array(self.column)
        # Folds go round within small buckets of each class, so every class is in every fold if it can be, and no task sorts a class.
        bucket = F.pmod(F.xxhash64(vec), F.lit(1024))
        fold = F.pmod(F.row_number().over(W.partitionBy("label_idx", bucket).orderBy(F.xxhash64(vec, F.lit(1)))) + bucket, F.lit(self.folds)).cast("int")
        rows = materialize(df.select(vec.alias("x"), F.col("label_idx").cast("int").alias("label_idx"), F.col("weight").cast("double").alias("weight"), fold.alias("fold")), "machines")
        sizes = rows.groupBy("label_idx", "fold").agg(F.sum("weight").alias("w"), F.max(F.size("x")).alias("width")).collect()  # classes x folds
        if not sizes:
            raise ValueError("no rows to learn from")
        width, classes, used = sizes[0]["width"], 1 + max(r["label_idx"] for r in sizes), sorted({r["fold"] for r in sizes})
        table = np.zeros((classes, self.folds))
        for r in sizes:
            table[r["label_idx"], r["fold"]] = r["w"]
        weights, constants = self._learnt(rows, table, [-1, *used], width)
        a, b = sigmoids(materialize(self._held_out(rows, used, weights[classes:], constants[classes:]), "margins"))
        machines = [(c, weights[c].tolist(), float(constants[c]), float(a[c]), float(b[c])) for c in range(classes)]
        return CalibratedModel({"column": self.column}, tables={"machines": df.sparkSession.createDataFrame(machines, "label_idx int, weights array<double>, intercept double, a double, b double")})

    def _learnt(self, rows: DataFrame, table: np.ndarray, left_out: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and intercepts by (fold left out, class); -1 leaves none out. table: weights by class and fold."""
        classes = len(table)
        out, own = np.repeat(left_out, classes), np.tile(np.arange(classes), len(left_out))
        whole = np.array([table.sum() - (table[:, f].sum() if f >= 0 else 0) for f in out])
        mine = np.array([table[c].sum() - (table[c, f] if f >= 0 else 0) for f, c in zip(out, own, strict=True)])
        ways = [Descent(width + 1) for _ in own]
        for way, m, w in zip(ways, mine, whole, strict=True):  # a class without rows, or without others, has a constant margin
            if m <= 0 or m >= w:
                way.x[-1], way.done = (1.0 if m > 0 else -1.0), True
        for _ in range(self.iterations):
            going = [i for i, way in enumerate(ways) if not way.done]
            if not going:
                break
            at = np.stack([ways[i].trial for i in going])
            losses, gradients = self._pass(rows, at, out[going], own[going])
            for k, i in enumerate(going):
                inner = at[k, :-1] / (self.c * whole[i])
                ways[i].tell(losses[k] / whole[i] + float(inner @ at[k, :-1]) / 2, gradients[k] / whole[i] + np.append(inner, 0.0))
        return np.stack([way.x[:-1] for way in ways]), np.array([way.x[-1] for way in ways])

    def _pass(self, rows: DataFrame, at: np.ndarray, out: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of loss and gradient of each machine: one scan, a row a machine and task."""
        shared, corner = rows.sparkSession.sparkContext.broadcast((at, out, own)), self.corner

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, out, own = shared.value
            sums = np.zeros((len(at), at.shape[1] + 1))
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                    label, weight, fold = (batch.column(i).to_numpy() for i in (1, 2, 3))
                    sign = np.where(label[:, None] == own[None, :], 1.0, -1.0)
                    short = 1 - sign * (x @ at[:, :-1].T + at[:, -1])
                    counted = weight[:, None] * (fold[:, None] != out[None, :])
                    bend = np.clip((short + corner) / (2 * corner), 0, 1)  # 0 beyond the hinge, 1 before it
                    sums[:, 0] += (counted * np.where(bend < 1, corner * bend * bend, short)).sum(axis=0)
                    pull = -counted * sign * bend
                    sums[:, 1:-1] += pull.T @ x
                    sums[:, -1] += pull.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at), dtype=np.int32)), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["m", "v"])

        size = at.shape[1] + 1
        added = F.aggregate(F.collect_list("v"), F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda p, q: p + q))  # an array a task
        found = rows.mapInArrow(run, "m int, v array<double>").groupBy("m").agg(added.alias("v")).collect()
        sums = np.array([r["v"] for r in sorted(found)])
        return sums[:, 0], sums[:, 1:]

    @staticmethod
    def _held_out(rows: DataFrame, used: list[int], weights: np.ndarray, constants: np.ndarray) -> DataFrame:
        """label_idx, margins: each row by the machines that didn't learn from its fold."""
        classes = len(weights) // len(used)
        shared = rows.sparkSession.sparkContext.broadcast((np.array(used), weights, constants))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            used, weights, constants = shared.value
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                    every = (x @ weights.T + constants).reshape(len(x), len(used), classes)
                    margins = every[np.arange(len(x)), np.searchsorted(used, batch.column(3).to_numpy())]
                    yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(margins.tolist(), pa.list_(pa.float64()))], names=["label_idx", "margins"])

        return rows.mapInArrow(run, "label_idx int, margins array<double>")


def _margins(rows: DataFrame, machines: list[tuple[np.ndarray, float]], column: str) -> DataFrame:
    """rows with margins: one number a class."""
    matrix, shift = np.stack([w for w, _ in machines]), np.array([i for _, i in machines])

    @F.pandas_udf("array<double>")
    def margins(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()) @ matrix.T + shift) if len(x) else [], dtype=object)

    return rows.withColumn("margins", margins(vector_to_array(column)))


class CalibratedModel(Stored):
    """rawPrediction: margins; probability: sigmoids of the margins, over their sum."""

    def _transform(self, df: DataFrame) -> DataFrame:
        if not hasattr(self, "_known"):
            self._known = sorted(self.tables["machines"].collect())  # a row a class
        known = self._known
        slope, shift = (F.array(*[F.lit(r[c]) for r in known]) for c in ("a", "b"))
        out = _margins(df, [(np.array(r["weights"]), r["intercept"]) for r in known], self.values["column"])
        squashed = F.transform(F.arrays_zip(F.col("margins").alias("m"), slope.alias("a"), shift.alias("b")), lambda z: F.lit(1.0) / (F.exp(z["a"] * z["m"] + z["b"]) + 1))
        out = out.withColumn("_p", F.transform(squashed, lambda p: F.greatest(p, F.lit(1e-12))))
        whole = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p)
        return out.withColumn("probability", array_to_vector(F.transform("_p", lambda p: p / whole))).withColumn("rawPrediction", array_to_vector("margins")).drop("_p", "margins")


class RandomFeatures(Estimator):
    """A column becomes cos(w x + b) of seeded random directions: dot products come near those of a Gaussian kernel of width
    gamma = 1 / (number of entries * their variance)."""

    def __init__(self, column: str, out: str = "_lifted", size: int = 256, seed: int = 42):
        super().__init__()
        self.column, self.out, self.size, self.seed = column, out, size, seed

    def _fit(self, df: DataFrame) -> RandomFeaturesModel:
        entries = vector_to_array(self.column)
        row = df.select(F.explode(entries).alias("x"), F.size(entries).alias("n")).agg(F.var_pop("x"), F.max("n")).first()
        width = row[1] or 0
        return RandomFeaturesModel({"column": self.column, "out": self.out, "size": self.size, "seed": self.seed, "width": width, "gamma": 1.0 / (width * row[0]) if row[0] else 1.0})


class RandomFeaturesModel(Stored):
    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values
        rng = np.random.default_rng(v["seed"])
        w, b, scale = rng.normal(0, math.sqrt(2 * v["gamma"]), (v["size"], v["width"])), rng.uniform(0, 2 * math.pi, v["size"]), math.sqrt(2 / v["size"])

        @F.pandas_udf("array<double>")
        def lift(x: pd.Series) -> pd.Series:
            return pd.Series(list(scale * np.cos(np.stack(x.to_numpy()) @ w.T + b)) if len(x) else [], dtype=object)

        return df.withColumn(v["out"], array_to_vector(lift(vector_to_array(v["column"]))))
