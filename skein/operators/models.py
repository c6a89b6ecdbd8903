"""Classifiers on feature tables, out-of-fold stacking and cross-validation, on Spark ML.

A feature table has a key, label_idx and a vector column `features`. Probability tables are (key, probs array<double>).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import IntervalConfig
from ..functions.scalars import arg_max, num, softmax, top_k
from ..sources.shared import materialize
from . import evaluate as ev
from . import intervals as iv
from . import manifest
from .calibration import CalibratedMachines, RandomFeatures
from .neighbours import BLOCK, RING_ROWS, NeighbourIndex
from .stored import Stored
from .trees import Boosted, ExtraTrees


def column_stats(df: DataFrame, column: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each place of an array column: two numbers for each place."""
    rows = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    return np.array([r["m"] for r in rows]), np.array([r["s"] for r in rows])


def standard_scale(df: DataFrame, column: str = "features") -> DataFrame:
    """Each place less its mean, over its population deviation (a constant place is left at 0)."""
    mean, std = column_stats(df, column)
    scale = [F.array(*[F.lit(float(x)) for x in v]) for v in (mean, np.where(std > 0, std, 1.0))]
    return df.withColumn(column, F.transform(F.arrays_zip(F.col(column).alias("x"), scale[0].alias("m"), scale[1].alias("s")), lambda z: (z["x"] - z["m"]) / z["s"]))


def pca(df: DataFrame, share: float = 0.95, column: str = "features") -> PipelineModel:
    """Keeps as many principal components of df as explain that share of its variance: one fit of all, then a slice."""
    width = df.select(F.size(vector_to_array(column))).first()[0]
    whole = PCA(k=width, inputCol=column, outputCol="_pca").fit(df)
    k = int(np.searchsorted(np.cumsum(whole.explainedVariance.toArray()), share - 1e-12) + 1)
    return PipelineModel([whole, VectorSlicer(inputCol="_pca", outputCol=f"{column}_pca", indices=list(range(k)))])


def balanced(df: DataFrame) -> DataFrame:
    """Adds weight: N / (classes present * class size)."""
    sizes = df.groupBy("label_idx").agg(F.count(F.lit(1)).alias("_n"))
    whole = sizes.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = sizes.join(F.broadcast(whole)).select("label_idx", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), "label_idx")  # a row per class


class PlaceScaler(Stored):
    """features to _scaled by known means and deviations of places (a place without deviation becomes 0)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        each = F.arrays_zip(vector_to_array("features").alias("x"), F.lit(self.values["mean"]).alias("m"), F.lit(self.values["factor"]).alias("f"))
        return df.withColumn("_scaled", array_to_vector(F.transform(each, lambda z: (z["x"] - z["m"]) * z["f"])))


class PopulationScaler(Estimator):
    """features to _scaled: each place less its mean, over its population deviation. known: mean and deviation, where they needn't be measured."""

    def __init__(self, known: tuple[np.ndarray, np.ndarray] | None = None):
        super().__init__()
        self.known = known

    def _fit(self, df: DataFrame) -> Model:
        if self.known is not None:
            mean, std = self.known
            return PlaceScaler({"mean": mean.tolist(), "factor": np.where(std > 0, 1 / np.where(std > 0, std, 1), 0.0).tolist()})
        n = df.count()
        scaled = StandardScaler(inputCol="features", outputCol="_sample", withMean=True).fit(df)
        width = len(scaled.mean)
        grow = ElementwiseProduct(inputCol="_sample", outputCol="_scaled", scalingVec=Vectors.dense([math.sqrt(n / max(n - 1, 1))] * width))
        return PipelineModel([scaled, grow])


class VarianceShare(Estimator):
    """Principal components of _scaled that explain `share` of its variance take its place (as _scaled_pca)."""

    def __init__(self, share: float):
        super().__init__()
        self.share = share

    def _fit(self, df: DataFrame) -> PipelineModel:
        return pca(df, self.share, "_scaled")


class Logistic(Estimator):
    """Multinomial logistic regression with penalty `c` on errors: coefficients are penalised by 1 / (c * sum of weights)."""

    def __init__(self, column: str, c: float = 1.0, iterations: int = 50):
        super().__init__()
        self.column, self.c, self.iterations = column, c, iterations

    def _fit(self, df: DataFrame) -> Model:
        whole = df.agg(F.sum("weight")).first()[0]
        return LogisticRegression(featuresCol=self.column, labelCol="label_idx", weightCol="weight", family="multinomial", standardization=False, regParam=1 / (self.c * whole), maxIter=self.iterations).fit(df)


class Neighbours(Estimator):
    def __init__(self, column: str, k: int = 9):
        super().__init__()
        self.column, self.k = column, k

    def _fit(self, df: DataFrame) -> NeighbourModel:
        vec = vector_to_array(self.column)
        # A row's number comes from what it holds, so ties fall alike in every run; equal rows are interchangeable.
        rows = df.select(F.xxhash64(vec, "label_idx").alias("id"), F.col("label_idx").cast("int").alias("label_idx"), vec.alias("vec"))
        classes = 1 + (df.agg(F.max("label_idx")).first()[0] or 0)
        return NeighbourModel({"column": self.column, "k": self.k, "classes": classes}, tables={"rows": materialize(rows, "neighbours")})


class NeighbourModel(Stored):
    """The rows that it learnt from, as a table; a row's probabilities are its neighbours' shares of the vote."""

    def _transform(self, df: DataFrame) -> DataFrame:
        if not hasattr(self, "_index"):
            self._index = NeighbourIndex(self.tables["rows"])
        own = F.xxhash64(vector_to_array(self.values["column"]))  # rows with equal features have equal neighbours
        asked = df.select(own.alias("key"), vector_to_array(self.values["column"]).alias("vec")).dropDuplicates(["key"])
        votes = _votes(self._index.search(asked, self.values["k"]))
        shares = votes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("label_idx", "w"))).alias("_m"), F.sum("w").alias("_w"))
        probs = F.transform(F.sequence(F.lit(0), F.lit(self.values["classes"] - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), num(0)) / F.col("_w"))
        return df.withColumn("key", own).join(shares, "key", "left").withColumn("probability", array_to_vector(probs)).drop("key", "_m", "_w")


class Voting(Estimator):
    def __init__(self, members: list[tuple[Estimator, float]]):
        super().__init__()
        self.members = members

    def _fit(self, df: DataFrame) -> VotingModel:
        return VotingModel({"weights": [w for _, w in self.members]}, {f"member{i}": one.fit(df) for i, (one, _) in enumerate(self.members)})


class VotingModel(Stored):
    """The weighted mean of the members' probabilities."""

    def _transform(self, df: DataFrame) -> DataFrame:
        weights, sums = self.values["weights"], []
        for i, weight in enumerate(weights):
            before = df.columns
            df = self.parts[f"member{i}"].transform(df)
            df = df.select(*before, F.transform(_probabilities(df), lambda p: p * num(weight / sum(weights))).alias(f"_p{i}"))  # noqa: B023
            sums.append(f"_p{i}")
        mean = F.col(sums[0])
        for c in sums[1:]:
            mean = F.zip_with(mean, F.col(c), lambda a, b: a + b)
        return df.withColumn("probability", array_to_vector(mean)).drop(*sums)


def _forest(column: str, trees: int = 400, depth: int = 10) -> Estimator:
    return RandomForestClassifier(featuresCol=column, labelCol="label_idx", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=42)


#: By name, the stages behind the scaler. Penalties 1 and 10, 400 and 500 trees of 2 rows a leaf, 700 rounds of depth 6, rate 0.05, l2 5.
MODELS: dict[str, Callable[..., list[Estimator]]] = {
    "lr": lambda column, **kw: [Logistic(column, **kw)],
    "svm_linear": lambda column, **kw: [CalibratedMachines(column, **kw)],
    "svm_rbf": lambda column, size=256, c=10.0, **kw: [RandomFeatures(column, "_lifted", size), CalibratedMachines("_lifted", c, **kw)],
    "knn": lambda column, **kw: [Neighbours(column, **kw)],
    "rf": lambda column, **kw: [_forest(column, **kw)],
    "extra_trees": lambda column, **kw: [ExtraTrees(column, **kw)],
    "gbt": lambda column, trees=700, **kw: [Boosted(column, trees, **kw)],
}
MODELS["svm"] = MODELS["svm_rbf"]
NAMES = (*MODELS, "ensemble")
#: The members of the ensemble and their weights.
ENSEMBLE = (("svm_rbf", 2.0), ("extra_trees", 2.0), ("lr", 1.0), ("gbt", 2.0))


def build(name: str, share: float | None = None, **options) -> Estimator:
    """The named classifier behind a scaler and, with `share`, principal components of that share of the variance.

    options: of the classifier; for the ensemble, a dictionary of them by member."""
    if name not in NAMES:
        raise ValueError(f"no model {name}: {sorted(NAMES)}")
    if name == "ensemble":
        return Voting([(build(member, share, **options.get(member, {})), weight) for member, weight in ENSEMBLE])
    before = [PopulationScaler(), *([] if share is None else [VarianceShare(share)])]
    return Pipeline(stages=[*before, *MODELS[name]("_scaled" if share is None else "_scaled_pca", **options)])


def fit(name: str, train: DataFrame, **options) -> Model:
    return build(name, **options).fit(balanced(train))


def _probabilities(out: DataFrame) -> Column:
    """Of a model's output; margins become probabilities by softmax."""
    return vector_to_array("probability") if "probability" in out.columns else softmax(vector_to_array("rawPrediction"))


def predict(model: Model, df: DataFrame, key: list[str]) -> DataFrame:
    """key, probs, y_pred, confidence."""
    out = model.transform(df)
    return out.select(*key, _probabilities(out).alias("probs")).withColumn("y_pred", arg_max(F.col("probs"))).withColumn("confidence", F.array_max("probs"))


def _votes(found: DataFrame) -> DataFrame:
    """key, best -> key, label_idx, w: votes weighted by 1 / distance; at distance 0 only those vote."""
    near = found.select("key", F.get("best", F.lit(0))["d"].alias("_least"), F.explode("best").alias("b"))
    weight = F.when(F.col("_least") == 0, (F.col("b.d") == 0).cast("double")).otherwise(num(1) / F.col("b.d"))
    return near.groupBy("key", F.col("b.label_idx").alias("label_idx")).agg(F.sum(weight).alias("w"))


def neighbour_votes(train: DataFrame, queries: DataFrame, key: str, k: int = 9, part: int = RING_ROWS, block: int = BLOCK) -> DataFrame:
    """key, label_idx, w: votes among the k nearest, exact at any size (ties: the lower id). train(id, label_idx, vec), queries(key, vec).

    part: rows of a ring of the index; block: queries that meet a ring at once."""
    found = NeighbourIndex(train, ring_rows=part, block=block).search(queries.select(F.col(key).alias("key"), "vec"), k)
    return _votes(found).withColumnRenamed("key", key)


def knn(train: DataFrame, queries: DataFrame, key: str, k: int = 9, **options) -> DataFrame:
    """key, y_pred: the label with the largest vote (ties: the lowest)."""
    votes = neighbour_votes(train, queries, key, k, **options)
    return votes.groupBy(key).agg(F.max_by("label_idx", F.struct("w", -F.col("label_idx"))).alias("y_pred"))


def out_of_fold(df: DataFrame, folds: DataFrame, names: list[str], key: str, options: dict | None = None) -> DataFrame:
    """model, key, fold, label_idx, probs: every row is scored by models that never saw its fold. folds(key, fold).

    Rows with their folds are written once, and so are the scores of each model."""
    rows, out = materialize(df.select(key, "label_idx", "features").join(folds.select(key, "fold"), key), "oof-rows"), None
    for f in [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]:
        train, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        for name in names:
            one = materialize(predict(fit(name, train, **(options or {}).get(name, {})), test, [key, "fold", "label_idx"]).withColumn("model", F.lit(name)), "oof")
            out = one if out is None else out.unionByName(one)
    return out.select("model", key, "fold", "label_idx", "probs")


def meta_table(oof: DataFrame, names: list[str], key: str) -> DataFrame:
    """key, label_idx, features: the models' probabilities side by side."""
    order = F.array_position(F.lit(names), F.col("model"))
    rows = oof.groupBy(key, "label_idx").agg(F.array_sort(F.collect_list(F.struct(order.alias("m"), "probs"))).alias("_l"))
    return rows.where(F.size("_l") == len(names)).select(key, "label_idx", array_to_vector(F.flatten(F.transform("_l", lambda x: x["probs"]))).alias("features"))


class Stack:
    """Base models, and a logistic regression on their out-of-fold probabilities; the bases are then fitted on all rows."""

    def __init__(self, df: DataFrame, folds: DataFrame, names: list[str], key: str, options: dict | None = None):
        self.names, self.key = names, key
        self.oof = out_of_fold(df, folds, names, key, options)
        self.meta = fit("lr", meta_table(self.oof, names, key))
        self.bases = {name: fit(name, df, **(options or {}).get(name, {})) for name in names}

    def predict(self, df: DataFrame) -> DataFrame:
        rows = None
        for name, model in self.bases.items():
            one = predict(model, df, [self.key]).select(self.key, "probs", F.lit(name).alias("model"), F.lit(0).alias("label_idx"))
            rows = one if rows is None else rows.unionByName(one)
        return predict(self.meta, meta_table(rows, self.names, self.key), [self.key])


def fold_stats(bank: DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Mean and population deviation of each place without fold (repeat, fold), from bank(repeat, fold, features): each fold's sums, taken
    from its repeat's. Values are counted from a mean of all, so that what is taken away is small beside what stays."""
    entries = bank.select("repeat", "fold", F.posexplode(vector_to_array("features")).alias("i", "x"))
    middle = entries.groupBy("i").agg(F.avg("x").alias("_m"))  # a row a place
    off = entries.join(F.broadcast(middle), "i").withColumn("x", F.col("x") - F.col("_m"))
    rows = off.groupBy("repeat", "fold", "i").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.max("_m").alias("m")).collect()  # folds x places
    width, out = 1 + max((r["i"] for r in rows), default=-1), {}
    sums = {key: np.zeros((3, width)) for key in {(r["repeat"], r["fold"]) for r in rows}}
    mean = np.zeros(width)
    for r in rows:
        sums[r["repeat"], r["fold"]][:, r["i"]], mean[r["i"]] = (r["n"], r["s"], r["q"]), r["m"]
    for repeat, fold in sums:
        n, s, q = sum(v for (other, _), v in sums.items() if other == repeat) - sums[repeat, fold]
        n = np.maximum(n, 1)
        variance = q / n - (s / n) ** 2
        out[repeat, fold] = mean + s / n, np.sqrt(np.where(variance > 1e-14 * (q / n), variance, 0.0))
    return out


def cross_validate(df: DataFrame, folds: DataFrame, factory: Callable[[], Estimator], key: str, train_bank: DataFrame | None = None, parallel: int = 4) -> DataFrame:
    """metric, mean, ci95_low, ci95_high, n over all (repeat, fold). folds(repeat, fold, key).

    df: the segments that are scored (key, seg_idx, label_idx, features; one row a key if there is no seg_idx); train_bank: those
    that models learn from, df itself if not given. A key's segments vote by mean probability, and keys are what is counted.

    Both are computed once and written with their folds; all folds learn from that bank, `parallel` at a time. A model that begins with a
    PopulationScaler gets its fold's means and deviations from the bank's sums less the fold's, without a pass of its own."""
    evaluated = df if "seg_idx" in df.columns else df.withColumn("seg_idx", F.lit(0))
    dealt = folds.select("repeat", "fold", key)
    scored = materialize(evaluated.select(key, "seg_idx", "label_idx", "features").join(dealt, key), "cv-scored")
    learned = scored if train_bank is None else materialize(train_bank.select(key, "label_idx", "features").join(dealt, key), "cv-learned")
    stats = fold_stats(learned)

    def one(at: tuple[int, int]) -> tuple[float, float, float]:
        repeat, fold = at
        estimator = factory()
        if isinstance(estimator, Pipeline) and isinstance(estimator.getStages()[0], PopulationScaler) and at in stats:
            estimator = Pipeline(stages=[PopulationScaler(stats[at]), *estimator.getStages()[1:]])
        mine = learned.where(F.col("repeat") == repeat)
        model = estimator.fit(balanced(mine.where(F.col("fold") != fold).drop("repeat", "fold")))
        held = scored.where((F.col("repeat") == repeat) & (F.col("fold") == fold))
        probs = predict(model, held, [key, "seg_idx"]).select(F.col(key).alias("track_id"), "seg_idx", F.posexplode("probs").alias("label_idx", "prob"))
        truth = ev.track_truth(held.select(F.col(key).alias("track_id"), "seg_idx", "label_idx"))
        row = ev.metrics(ev.track_vote(probs).join(truth, "track_id").select("y_true", "y_pred")).first()
        return row["acc"], row["macro_f1"], row["balanced_acc"]

    places = [(r["repeat"], r["fold"]) for r in folds.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]
    with ThreadPool(parallel) as pool:
        found = pool.map(inheritable_thread_target(df.sparkSession)(one), places)
    rows = [(metric, float(v)) for values in found for metric, v in zip(("acc", "macro_f1", "balanced_acc"), values, strict=True)]
    return ev.mean_ci95(df.sparkSession.createDataFrame(rows, "metric string, value double"), "value", ["metric"])


class TrackFeatures(Stored):
    """Frames to one vector a track, by settings that it carries. As the first stage of a model, it is stored and loaded with it, so the
    model takes frames, and no others' features can get in."""

    @classmethod
    def by(cls, cfg: IntervalConfig) -> TrackFeatures:
        return cls(asdict(cfg))

    @property
    def config(self) -> IntervalConfig:
        return IntervalConfig(**self.values)

    def _transform(self, frames: DataFrame) -> DataFrame:
        return iv.track_features(frames, None, self.config).withColumn("features", array_to_vector("features"))


def fit_frames(name: str, frames: DataFrame, labels: DataFrame, cfg: IntervalConfig, **options) -> PipelineModel:
    """A model from frames, for labels(track_id, label_idx): the track vectors are computed once, and the settings stay with the model.

    Labels are written first, so the tasks that make vectors don't hold what makes labels as well."""
    begin, known = TrackFeatures.by(cfg), materialize(labels.select("track_id", "label_idx"), "track-labels")
    vectors = materialize(begin.transform(frames).join(known, "track_id"), "track-vectors")
    return PipelineModel([begin, fit(name, vectors, **options)])


def predict_frames(frames: DataFrame, model: PipelineModel, labels: list[str], k: int, cfg: IntervalConfig | None = None) -> DataFrame:
    """track_id, place, label, prob: the best k labels of each track, straight from its frames. cfg: what the caller believes the
    settings to be; a model of others is refused."""
    begin = model.stages[0]
    if not isinstance(begin, TrackFeatures):
        raise ValueError("this model takes ready features, not frames")
    if cfg is not None and cfg.signature() != begin.config.signature():
        raise ValueError(f"the model's settings are {begin.config.signature()}, not {cfg.signature()}")
    ranked = F.posexplode(top_k(F.col("probs"), max(1, min(k, len(labels))))).alias("place", "_b")
    return predict(model, frames, ["track_id"]).select("track_id", ranked).select("track_id", "place", F.get(F.lit(labels), F.col("_b.place")).alias("label"), F.col("_b.value").alias("prob"))


def predict_series(segments: DataFrame, model: Model, labels: list[str], k: int, signature: str) -> DataFrame:
    """segments(track_id, seg_idx, features, cfg_sig) -> track_id, place, label, prob: mean over segments, best k labels.

    Features made under other settings than the model's are refused when they are read."""
    same = F.when(F.col("cfg_sig") == signature, F.col("features")).otherwise(F.raise_error(F.lit("features of other settings")))
    probs = predict(model, segments.withColumn("features", same), ["track_id", "seg_idx"]).select("track_id", F.posexplode("probs").alias("label_idx", "p"))
    means = probs.groupBy("track_id", "label_idx").agg(F.avg("p").alias("prob"))
    best = means.withColumn("place", F.row_number().over(W.partitionBy("track_id").orderBy(F.col("prob").desc(), "label_idx")) - 1)
    return best.where(F.col("place") < max(1, min(k, len(labels)))).select("track_id", "place", F.get(F.lit(labels), F.col("label_idx")).alias("label"), "prob")


def folds(df: DataFrame, key: str, k: int, repeats: int = 1, seed: int = 42) -> DataFrame:
    rows = df.select(F.col(key).alias("track_id"), F.col("label_idx").cast("string").alias("label"), F.col(key).cast("string").alias("path"))
    return manifest.stratified_folds(rows, k, repeats, seed).withColumnRenamed("track_id", key)
