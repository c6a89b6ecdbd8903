"""Trees grown by aggregates: extremely randomised forests and multiclass boosting.

A tree grows a level at a time, all trees of a group together. Tasks walk their rows down the trees so far and sum what the splits
need for each (tree, node, feature) in arrays; Spark adds the tasks' sums, picks each node's split, and the driver only sees one row a
node. Rows are never sorted, moved or written again for a level, so the work is a scan of a table at rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .stored import Stored

ROWS_AT_ONCE = 2_000_000  # (row, tree) pairs that a task walks at once


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that depend on all parts, which are broadcast together."""
    x = np.zeros(np.broadcast_shapes(*[np.shape(p) for p in parts]), np.uint64)
    for p in parts:
        x = (x ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(29))
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


class Forest:
    """Binary trees in flat arrays. Node i of a tree splits by x[feature] > threshold into left and right, or is a leaf (feature -1)
    with its payload. `path` is a node's number in its tree: 1 for the root, then twice the parent's, plus 1 on the right."""

    def __init__(self, roots: int, width: int):
        self.feature, self.threshold = np.full(roots, -1, np.int32), np.zeros(roots)
        self.left, self.right = np.zeros(roots, np.int32), np.zeros(roots, np.int32)
        self.payload, self.tree, self.path = np.zeros((roots, width)), np.arange(roots, dtype=np.int32), np.ones(roots, np.int64)
        self.roots = np.arange(roots)

    def split(self, nodes: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gives nodes two children each, with these payloads; their places."""
        n, at = len(nodes), len(self.feature)
        a, b = at + np.arange(n), at + n + np.arange(n)
        self.feature[nodes], self.threshold[nodes], self.left[nodes], self.right[nodes] = feature, threshold, a, b
        both = np.concatenate([nodes, nodes])
        self.feature, self.threshold = np.concatenate([self.feature, np.full(2 * n, -1, np.int32)]), np.concatenate([self.threshold, np.zeros(2 * n)])
        self.left, self.right = (np.concatenate([x, np.zeros(2 * n, np.int32)]) for x in (self.left, self.right))
        self.payload, self.tree = np.concatenate([self.payload, left, right]), np.concatenate([self.tree, self.tree[both]])
        self.path = np.concatenate([self.path, self.path[nodes] * 2, self.path[nodes] * 2 + 1])
        return a, b

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x in each tree."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = x[rows, np.where(inner, feature, 0)] > self.threshold[at]
            at = np.where(inner, np.where(right, self.right[at], self.left[at]), at)

    def table(self) -> pa.Table:
        columns = {k: getattr(self, k) for k in ("feature", "threshold", "left", "right", "tree", "path")}
        return pa.table({"node": np.arange(len(self.feature), dtype=np.int64), **columns, "payload": pa.array(self.payload.tolist(), pa.list_(pa.float64()))})

    @classmethod
    def of(cls, rows: DataFrame) -> Forest:
        """The reverse of table(): as many rows as the model has nodes."""
        t = rows.toArrow().sort_by("node")
        out = cls(0, 0)
        for k in ("feature", "threshold", "left", "right", "tree", "path"):
            setattr(out, k, t[k].to_numpy().copy())
        out.payload = np.array(t["payload"].to_pylist()).reshape(t.num_rows, -1)
        out.roots = np.flatnonzero(out.path == 1)
        return out

    def over_rows(self, x: np.ndarray, use: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """use(leaves) of a few rows at a time, put together."""
        step = max(1, ROWS_AT_ONCE // max(1, len(self.roots)))
        return np.concatenate([use(self.walk(x[lo : lo + step])) for lo in range(0, len(x), step)])


def _features(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _learnt_from(df: DataFrame, column: str) -> tuple[DataFrame, int, int]:
    """The rows at rest (x, label_idx, weight), their width and the number of classes."""
    rows = materialize(df.select(vector_to_array(column).alias("x"), F.col("label_idx").cast("int").alias("label_idx"), F.col("weight").cast("double").alias("weight")), "trees")
    width, classes = rows.agg(F.max(F.size("x")), F.max("label_idx") + 1).first()
    if not classes:
        raise ValueError("no rows to learn from")
    return rows, width, classes


# --- extremely randomised trees ----------------------------------------------------------------------------------


def drawn_features(seed: int, tree: np.ndarray, path: np.ndarray, width: int, m: int) -> np.ndarray:
    """m different features for each node: those whose draws are least."""
    draws = mixed(seed, tree[:, None], path[:, None], np.arange(width)[None, :])
    return np.argsort(draws, axis=1, kind="stable")[:, :m].astype(np.int32)


def drawn_thresholds(seed: int, tree: np.ndarray, path: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Uniform between a feature's least and largest value in its node; low itself where they are equal."""
    return low + (high - low) * mixed(seed + 1, tree[:, None], path[:, None], features)


class ExtraTrees(Estimator):
    """Each node draws sqrt(width) features, and for each a threshold between its least and largest value there; the best of these splits by
    Gini impurity is taken, none is searched for. Trees learn from all rows. A node is a leaf at `depth`, if it is pure, if it has fewer than twice
    `min_leaf` rows, or if no drawn split leaves `min_leaf` rows on both sides."""

    def __init__(self, column: str, trees: int = 500, depth: int = 10, min_leaf: int = 2, seed: int = 42, group: int = 64):
        super().__init__()
        self.column, self.trees, self.depth, self.min_leaf, self.seed, self.group = column, trees, depth, min_leaf, seed, group

    def _fit(self, df: DataFrame) -> ForestModel:
        rows, width, classes = _learnt_from(df, self.column)
        whole = np.zeros((classes, 2))
        for r in rows.groupBy("label_idx").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect():  # a row a class
            whole[r["label_idx"]] = r["w"], r["n"]
        parts = [self._grown(rows, np.arange(lo, min(self.trees, lo + self.group)), width, whole) for lo in range(0, self.trees, self.group)]
        tables = [p.table() for p in parts]
        at, shifted = 0, []
        for t in tables:  # one numbering for all groups
            cols = {k: t[k].to_numpy() + (at if k in ("node", "left", "right") else 0) for k in t.column_names if k != "payload"}
            shifted.append(pa.table({**cols, "payload": t["payload"]}))
            at += t.num_rows
        nodes = df.sparkSession.createDataFrame(pa.concat_tables(shifted))
        return ForestModel({"column": self.column, "classes": classes}, tables={"nodes": materialize(nodes, "forest")})

    def _grown(self, rows: DataFrame, trees: np.ndarray, width: int, whole: np.ndarray) -> Forest:
        classes, m = len(whole), max(1, int(math.sqrt(width)))
        forest = Forest(len(trees), classes)
        forest.tree = trees.astype(np.int32)
        forest.payload[:] = whole[:, 0]
        open_nodes, counts = forest.roots, np.full(len(trees), whole[:, 1].sum())
        for _ in range(self.depth):
            mixed_up = (forest.payload[open_nodes] > 0).sum(axis=1) > 1
            open_nodes = open_nodes[mixed_up & (counts >= 2 * self.min_leaf)]
            if not len(open_nodes):
                break
            tree, path = forest.tree[open_nodes], forest.path[open_nodes]
            features = drawn_features(self.seed, tree, path, width, m)
            low, high = self._ranges(rows, forest, open_nodes, features)
            thresholds = drawn_thresholds(self.seed, tree, path, features, low, high)
            best = self._best(rows, forest, open_nodes, features, thresholds, classes)
            if not best:
                break
            at = np.array([r["node"] for r in best])
            slot, (left, right) = np.array([r["slot"] for r in best]), (np.array([[c[k] for c in r["parts"]] for r in best]) for k in ("lw", "rw"))
            a, b = forest.split(open_nodes[at], features[at, slot], thresholds[at, slot], left, right)
            open_nodes, counts = np.concatenate([a, b]), np.concatenate([[r["ln"] for r in best], [r["rn"] for r in best]])
        return forest

    @staticmethod
    def _entries(batches: Iterator[pa.RecordBatch], forest: Forest, place: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """x, labels, weights of a few rows, then (row, open node) of all that lie in open nodes, in order of the node."""
        step = max(1, ROWS_AT_ONCE // len(forest.roots))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = _features(part.column(0))
                node = place[forest.walk(x)]
                row, tree = np.nonzero(node >= 0)
                node = node[row, tree]
                order = np.argsort(node, kind="stable")
                yield x, part.column(1).to_numpy(), part.column(2).to_numpy(), row[order], node[order]

    def _ranges(self, rows: DataFrame, forest: Forest, open_nodes: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest value of each drawn feature in each open node."""
        m, place = features.shape[1], np.full(len(forest.feature), -1, np.int64)
        place[open_nodes] = np.arange(len(open_nodes))
        shared = rows.sparkSession.sparkContext.broadcast((forest, place, features))  # grows with the model, not with the data

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, place, features = shared.value
            low, high = np.full(features.shape, np.inf), np.full(features.shape, -np.inf)
            for x, _, _, row, node in ExtraTrees._entries(batches, forest, place):
                if len(node):
                    first = np.flatnonzero(np.diff(node, prepend=-1))
                    for s in range(features.shape[1]):
                        v = x[row, features[node, s]]
                        own = node[first]
                        low[own, s] = np.minimum(low[own, s], np.minimum.reduceat(v, first))
                        high[own, s] = np.maximum(high[own, s], np.maximum.reduceat(v, first))
            n, s = np.nonzero(low <= high)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(s), pa.array(low[n, s]), pa.array(high[n, s])], names=["node", "slot", "low", "high"])

        found = rows.mapInArrow(run, "node long, slot long, low double, high double").groupBy("node", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        low, high = np.zeros((len(open_nodes), m)), np.zeros((len(open_nodes), m))
        at = found["node"].to_numpy(), found["slot"].to_numpy()
        low[at], high[at] = found["low"].to_numpy(), found["high"].to_numpy()
        return low, high

    def _best(self, rows: DataFrame, forest: Forest, open_nodes: np.ndarray, features: np.ndarray, thresholds: np.ndarray, classes: int) -> list:
        """node, slot, parts (by class: lw, rw), ln, rn of the best drawn split of each open node that has one."""
        place = np.full(len(forest.feature), -1, np.int64)
        place[open_nodes] = np.arange(len(open_nodes))
        shared = rows.sparkSession.sparkContext.broadcast((forest, place, features, thresholds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, place, features, thresholds = shared.value
            n, m = features.shape
            sums = np.zeros((m, 2, 2, n * classes))  # slot, side, (weight, rows), node and class
            for x, label, weight, row, node in ExtraTrees._entries(batches, forest, place):
                cell, w = node * classes + label[row], weight[row]
                for s in range(m):
                    right = x[row, features[node, s]] > thresholds[node, s]
                    for side, own in enumerate((~right, right)):
                        sums[s, side, 0] += np.bincount(cell[own], w[own], n * classes)
                        sums[s, side, 1] += np.bincount(cell[own], minlength=n * classes)
            s, cell = np.nonzero(sums[:, :, 1].sum(axis=1))
            names = ["node", "slot", "c", "lw", "rw", "ln", "rn"]
            yield pa.RecordBatch.from_arrays([pa.array(cell // classes), pa.array(s), pa.array((cell % classes).astype(np.int32)), *[pa.array(sums[s, side, k, cell]) for k in (0, 1) for side in (0, 1)]], names=names)

        cells = rows.mapInArrow(run, "node long, slot long, c int, lw double, rw double, ln double, rn double").groupBy("node", "slot", "c").agg(*[F.sum(x).alias(x) for x in ("lw", "rw", "ln", "rn")])
        all_classes = F.map_from_entries(F.collect_list(F.struct("c", F.struct("lw", "rw").alias("v"))))
        gain = sum((F.coalesce(F.try_divide(F.sum(F.col(w) * F.col(w)), F.sum(w)), F.lit(0.0)) for w in ("lw", "rw")), F.lit(0.0))
        splits = cells.groupBy("node", "slot").agg(gain.alias("gain"), F.sum("ln").alias("ln"), F.sum("rn").alias("rn"), all_classes.alias("_m")).where(f"ln >= {self.min_leaf} AND rn >= {self.min_leaf}")
        nothing = F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("rw"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.coalesce(F.try_element_at("_m", c), nothing))
        whole = splits.select("node", "slot", "gain", "ln", "rn", dense.alias("parts"))
        chosen = whole.groupBy("node").agg(F.max_by(F.struct("slot", "parts", "ln", "rn"), F.struct("gain", -F.col("slot"))).alias("s"))
        return chosen.select("node", "s.*").orderBy("node").collect()  # a row an open node


class ForestModel(Stored):
    """probability: the mean over trees of the class shares in a row's leaf."""

    def _transform(self, df: DataFrame) -> DataFrame:
        if not hasattr(self, "_shared"):
            forest = Forest.of(self.tables["nodes"])
            forest.payload = forest.payload / np.maximum(forest.payload.sum(axis=1, keepdims=True), 1e-300)
            self._shared = df.sparkSession.sparkContext.broadcast(forest)  # the model
        shared = self._shared

        @F.pandas_udf("array<double>")
        def probabilities(x: pd.Series) -> pd.Series:
            forest = shared.value
            return pd.Series(list(forest.over_rows(np.stack(x.to_numpy()), lambda leaf: forest.payload[leaf].mean(axis=1))) if len(x) else [], dtype=object)

        return df.withColumn("probability", array_to_vector(probabilities(vector_to_array(self.values["column"]))))


# --- multiclass boosting -----------------------------------------------------------------------------------------


def _softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Boosted(Estimator):
    """Gradient boosting of the softmax loss. A round grows one tree a class, all in the same passes, from histograms of first and second
    derivatives over `bins` quantile bins of each feature; a leaf's value is -rate * g / (h + l2).

    Rows carry their margins as of the last `refresh` rounds; the trees since then are walked in the pass itself."""

    def __init__(self, column: str, rounds: int = 700, depth: int = 6, rate: float = 0.05, l2: float = 5.0, bins: int = 64, refresh: int = 10):
        super().__init__()
        self.column, self.rounds, self.depth, self.rate, self.l2, self.bins, self.refresh = column, rounds, depth, rate, l2, min(bins, 255), refresh

    def _fit(self, df: DataFrame) -> BoostedModel:
        rows, width, classes = _learnt_from(df, self.column)
        edges = self._edges(rows, width)
        state = materialize(self._binned(rows, edges, classes), "boosted")
        done: list[Forest] = []  # all rounds' trees, by bin
        fresh, losses = 0, []
        for _ in range(self.rounds):
            if len(done) - fresh >= self.refresh:
                state, fresh = materialize(self._moved(state, done[fresh:], width), "boosted"), len(done)
            grown, loss = self._round(state, done[fresh:], width, classes)
            losses.append(loss)
            done.append(grown)
        losses.append(self._loss(state, done[fresh:], width))
        return BoostedModel({"column": self.column, "classes": classes, "losses": losses}, tables={"nodes": materialize(df.sparkSession.createDataFrame(self._all(done, edges)), "boosted")})

    def _edges(self, rows: DataFrame, width: int) -> list[np.ndarray]:
        """By feature, the values between bins: x is in the bin of as many edges as are below it."""
        shares = [k / self.bins for k in range(1, self.bins)]
        found = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.percentile_approx("v", shares, F.lit(10_000)).alias("q")).collect()  # width x bins numbers
        out = [np.zeros(0)] * width
        for r in found:
            out[r["i"]] = np.unique(np.array(r["q"]))
        return out

    def _binned(self, rows: DataFrame, edges: list[np.ndarray], classes: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _features(batch.column(0))
                binned = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in binned], pa.binary()), batch.column(1), batch.column(2), pa.array([[0.0] * classes] * len(x), pa.list_(pa.float64()))], names=["x", "label_idx", "weight", "margins"])

        return rows.mapInArrow(run, "x binary, label_idx int, weight double, margins array<double>")

    @staticmethod
    def _read(batches: Iterator[pa.RecordBatch], since: list[Forest], width: int) -> Iterator[tuple[np.ndarray, ...]]:
        """x (bins), labels, weights and present margins of a batch."""
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, width)
                margins = _features(batch.column(3)).copy()
                for forest in since:
                    margins += forest.over_rows(x, lambda leaf, forest=forest: forest.payload[leaf, 0])
                yield x, batch.column(1).to_numpy(), batch.column(2).to_numpy(), margins

    def _moved(self, state: DataFrame, since: list[Forest], width: int) -> DataFrame:
        shared = state.sparkSession.sparkContext.broadcast(since)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for *_, margins in Boosted._read(iter([batch]), shared.value, width):
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margins.tolist(), pa.list_(pa.float64()))], names=batch.schema.names)

        return state.mapInArrow(run, state.schema)

    def _loss(self, state: DataFrame, since: list[Forest], width: int) -> float:
        shared = state.sparkSession.sparkContext.broadcast(since)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, label, weight, margins in Boosted._read(batches, shared.value, width):
                p = _softmax(margins)[np.arange(len(label)), label]
                yield pa.RecordBatch.from_arrays([pa.array([float((-weight * np.log(np.maximum(p, 1e-300))).sum())]), pa.array([float(weight.sum())])], names=["loss", "w"])

        return state.mapInArrow(run, "loss double, w double").agg(F.sum("loss") / F.sum("w")).first()[0]

    def _round(self, state: DataFrame, since: list[Forest], width: int, classes: int) -> tuple[Forest, float]:
        """One tree a class, and the loss before them. payload: value, g, h and rows of a node."""
        growing, open_nodes, loss = Forest(classes, 4), np.arange(classes), math.nan
        for level in range(self.depth):
            best = self._best(state, since, growing, open_nodes, width, classes)
            if level == 0:
                loss = next(r["gain"] / r["h"] for r in best if r["node"] == -1)
            best = [r for r in best if r["node"] >= 0 and r["gain"] > 1e-12]
            if not best:
                break
            column = lambda *names: np.array([[r[k] for k in names] for r in best], float)
            value = lambda g, h: -self.rate * g / (h + self.l2)
            gl, hl, nl, g, h, n = column("gl", "hl", "nl", "g", "h", "n").T
            pay = lambda g, h, n: np.stack([value(g, h), g, h, n], axis=1)
            nodes = np.array([r["node"] for r in best])
            a, b = growing.split(nodes, np.array([r["feature"] for r in best]), np.array([r["bin"] for r in best], float), pay(gl, hl, nl), pay(g - gl, h - hl, n - nl))
            open_nodes = np.concatenate([a, b])[np.concatenate([nl, n - nl]) >= 2]
            if not len(open_nodes):
                break
        return growing, loss

    def _best(self, state: DataFrame, since: list[Forest], growing: Forest, open_nodes: np.ndarray, width: int, classes: int) -> list:
        """The best split of each open node; node -1 carries the loss (as gain) and the weight (as h)."""
        bins, l2, place = self.bins, self.l2, np.full(len(growing.feature), -1, np.int64)
        place[open_nodes] = np.arange(len(open_nodes))
        shared = state.sparkSession.sparkContext.broadcast((since, growing, place, open_nodes))  # trees of a few rounds

        def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            since, growing, place, open_nodes = shared.value
            sums, loss, whole = np.zeros((3, len(open_nodes) * width * bins)), 0.0, 0.0
            for x, label, weight, margins in Boosted._read(batches, since, width):
                p = _softmax(margins)
                loss -= float((weight * np.log(np.maximum(p[np.arange(len(label)), label], 1e-300))).sum())
                whole += float(weight.sum())
                leaves = growing.walk(x)
                for c in range(classes):
                    node = place[leaves[:, c]]
                    inside = np.flatnonzero(node >= 0)
                    g, h = weight * (p[:, c] - (label == c)), weight * p[:, c] * (1 - p[:, c])
                    cell = ((node[inside, None] * width + np.arange(width)[None, :]) * bins + x[inside]).ravel()
                    for k, v in enumerate((g, h, None)):
                        sums[k] += np.bincount(cell, None if v is None else np.repeat(v[inside], width), sums.shape[1])
            rows = np.moveaxis(sums.reshape(3, -1, bins), 0, 1).reshape(-1, 3 * bins)
            node, feature = np.repeat(open_nodes, width), np.tile(np.arange(width), len(open_nodes))
            extra = np.zeros((1, 3 * bins))
            extra[0, :2] = loss, whole
            names = ["node", "feature", "v"]
            flat = np.concatenate([rows, extra])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(node, -1)), pa.array(np.append(feature, 0).astype(np.int32)), pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * (3 * bins), pa.array(flat.ravel()))], names=names)

        added = F.aggregate(F.collect_list("v"), F.array_repeat(F.lit(0.0), 3 * bins), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))  # an array a task
        merged = state.mapInArrow(histograms, "node long, feature int, v array<double>").groupBy("node", "feature").agg(added.alias("v"))
        names = ["node", "feature", "bin", "gain", "gl", "hl", "nl", "g", "h", "n"]

        def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _features(batch.column(2)).reshape(batch.num_rows, 3, bins)
                left, whole = np.cumsum(v, axis=2)[:, :, :-1], v.sum(axis=2)
                gl, hl, nl = left[:, 0], left[:, 1], left[:, 2]
                g, h, n = (whole[:, k, None] for k in range(3))
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                gain = np.where((nl > 0) & (nl < n), gain, -1.0)
                at, rows = gain.argmax(axis=1), np.arange(batch.num_rows)
                node = batch.column(0).to_numpy()
                own = node == -1
                out = [at.astype(np.int32), np.where(own, v[:, 0, 0], gain[rows, at]), gl[rows, at], hl[rows, at], nl[rows, at], g[:, 0], np.where(own, v[:, 0, 1], h[:, 0]), n[:, 0]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out)], names=names)

        found = merged.mapInArrow(splits, "node long, feature int, bin int, gain double, gl double, hl double, nl double, g double, h double, n double")
        best = found.groupBy("node").agg(F.max_by(F.struct(*names[1:]), F.struct("gain", -F.col("feature"))).alias("s"))
        return best.select("node", "s.*").orderBy("node").collect()  # a row an open node

    def _all(self, rounds: list[Forest], edges: list[np.ndarray]) -> pa.Table:
        """All trees in one table, with thresholds in place of bins; a tree's number is round * classes + class, a payload its value."""
        parts, at, trees = [], 0, 0
        for f in rounds:
            inner = f.feature >= 0
            threshold = np.zeros(len(f.feature))
            threshold[inner] = [edges[i][int(b)] for i, b in zip(f.feature[inner], f.threshold[inner], strict=True)]
            columns = {"node": np.arange(len(f.feature), dtype=np.int64) + at, "feature": f.feature, "threshold": threshold, "left": f.left + at, "right": f.right + at, "tree": f.tree + trees, "path": f.path}
            parts.append(pa.table({**{k: pa.array(v) for k, v in columns.items()}, "payload": pa.array([[v] for v in f.payload[:, 0].tolist()], pa.list_(pa.float64()))}))
            at, trees = at + len(f.feature), trees + len(f.roots)
        return pa.concat_tables(parts)


class BoostedModel(Stored):
    """probability: softmax of the sums of a class's leaf values. values["losses"]: the mean loss before each round, and after the last."""

    def _transform(self, df: DataFrame) -> DataFrame:
        if not hasattr(self, "_shared"):
            self._shared = df.sparkSession.sparkContext.broadcast(Forest.of(self.tables["nodes"]))  # the model
        shared, classes = self._shared, self.values["classes"]

        @F.pandas_udf("array<double>")
        def probabilities(x: pd.Series) -> pd.Series:
            forest = shared.value
            if not len(x):
                return pd.Series([], dtype=object)
            margins = forest.over_rows(np.stack(x.to_numpy()), lambda leaf: forest.payload[leaf, 0].reshape(len(leaf), -1, classes).sum(axis=1))
            return pd.Series(list(_softmax(margins)), dtype=object)

        return df.withColumn("probability", array_to_vector(probabilities(vector_to_array(self.values["column"]))))
