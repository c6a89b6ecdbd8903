"""Queries of the classifiers. Labels are planted: the largest of the first three coordinates of an embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as sc
from ..operators import models as md
from .adapters import CFG, frames, table

#: Small ensembles: these queries show the operators, not the best scores.
OPTIONS = {"rf": {"trees": 20, "depth": 6}, "extra_trees": {"trees": 20, "depth": 6}, "gbt": {"trees": 5, "depth": 3}, "svm_linear": {"iterations": 15, "folds": 3}, "svm_rbf": {"iterations": 15, "folds": 3, "size": 64}, "lr": {"iterations": 30}}


def _table(spark: SparkSession, d: str) -> DataFrame:
    vec = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", vec.alias("vec"))
    return rows.select("vec_id", "vec", sc.arg_max(F.slice("vec", 1, 3)).alias("label_idx"), array_to_vector("vec").alias("features"))


def _parts(spark, d):
    rows = _table(spark, d)
    held = F.pmod(sc.stable_seed(F.col("vec_id").cast("string")), F.lit(4)) == 0
    return rows.where(~held), rows.where(held)


def _run(name: str, spark, d):
    train, test = _parts(spark, d)
    return md.predict(md.fit(name, train, **OPTIONS[name]), test, ["vec_id", "label_idx"]).select("vec_id", "label_idx", "y_pred", F.round("confidence", 4).alias("confidence"))


def lr_predict(spark, d):
    return _run("lr", spark, d)


def svm_linear_predict(spark, d):
    return _run("svm_linear", spark, d)


def svm_rbf_predict(spark, d):
    return _run("svm_rbf", spark, d)


def rf_predict(spark, d):
    return _run("rf", spark, d)


def extra_trees_predict(spark, d):
    return _run("extra_trees", spark, d)


def gbt_predict(spark, d):
    return _run("gbt", spark, d)


def gbt_losses(spark, d):
    """The mean training loss before each round of boosting, and after the last."""
    train, _ = _parts(spark, d)
    losses = md.fit("gbt", train, **OPTIONS["gbt"]).stages[-1].values["losses"]
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(losses)], "round int, loss double")


def pca_variance(spark, d):
    rows = _table(spark, d)
    kept = md.pca(rows, 0.95)
    reduced = kept.transform(rows)
    return reduced.select("vec_id", F.lit(len(kept.stages[-1].getIndices())).alias("size"), F.size(md.vector_to_array("features_pca")).alias("kept"))


def standard_scale(spark, d):
    scaled = md.standard_scale(_table(spark, d).select("vec_id", F.col("vec").alias("features")))
    return scaled.select("vec_id", F.posexplode("features").alias("place", "z")).select("vec_id", "place", F.round("z", 6).alias("z"))


def knn_predict(spark, d):
    train, test = _parts(spark, d)
    return md.knn(train.select(F.col("vec_id").alias("id"), "label_idx", "vec"), test.select("vec_id", "vec"), "vec_id")


def oof_predictions(spark, d):
    rows = _table(spark, d)
    oof = md.out_of_fold(rows, md.folds(rows, "vec_id", 3).select("vec_id", "fold"), ["lr", "rf"], "vec_id", OPTIONS)
    return oof.select("model", "vec_id", "fold", "label_idx", sc.arg_max(F.col("probs")).alias("y_pred"))


def stacking_predict(spark, d):
    train, test = _parts(spark, d)
    stack = md.Stack(train, md.folds(train, "vec_id", 3).select("vec_id", "fold"), ["lr", "rf"], "vec_id", OPTIONS)
    return stack.predict(test).select("vec_id", "y_pred", F.round("confidence", 4).alias("confidence"))


def cv_summary(spark, d):
    """A label's embeddings are dealt to tracks of four segments; tracks are split, trained on, voted over and scored."""
    place = F.row_number().over(W.partitionBy("label_idx").orderBy("vec_id")) - 1
    rows = _table(spark, d).withColumn("_k", place).withColumn("track_id", F.floor(F.col("_k") / 4) * 3 + F.col("label_idx")).withColumn("seg_idx", F.col("_k") % 4)
    tracks = rows.groupBy("track_id").agg(F.first("label_idx").alias("label_idx"))
    return md.cross_validate(rows, md.folds(tracks, "track_id", 3), lambda: md.build("lr", **OPTIONS["lr"]), "track_id").select(
        "metric", *[F.round(c, 4).alias(c) for c in ("mean", "ci95_low", "ci95_high")], "n")


def predict_frames(spark, d):
    """Tracks of events: learnt from the frames of three users in four, predicted from the frames of all. The planted label is the
    third of the pitch range, taken by hundreds of hertz, that most of a user's frames lie in."""
    held = frames(spark, d)
    third = F.pmod(F.floor(F.col("f0_hz") / 100), F.lit(3)).cast("int")
    counts = held.groupBy("track_id", third.alias("label_idx")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.groupBy("track_id").agg(F.max_by("label_idx", F.struct("n", -F.col("label_idx"))).alias("label_idx"))
    model = md.fit_frames("lr", held, labels.where(F.pmod(F.xxhash64("track_id"), F.lit(4)) > 0), CFG, **OPTIONS["lr"])
    return md.predict_frames(held, model, ["a", "b", "c"], 2, CFG).select("track_id", "place", "label", F.round("prob", 4).alias("prob"))


def predict_table(spark, d):
    train, _ = _parts(spark, d)
    model = md.fit("lr", train, **OPTIONS["lr"])
    segments = _table(spark, d).select((F.col("vec_id") % 125).alias("track_id"), F.floor(F.col("vec_id") / 125).cast("int").alias("seg_idx"), "features", F.lit("v1").alias("cfg_sig"))
    return md.predict_series(segments, model, ["a", "b", "c"], 2, "v1").select("track_id", "place", "label", F.round("prob", 4).alias("prob"))


ORACLES = {
    "standard_scale": """WITH flat AS (SELECT vec_id, CAST(i AS INTEGER) AS place, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i))
        SELECT vec_id, place, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS z FROM flat WINDOW w AS (PARTITION BY place)""",
    "knn_predict": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 0 WHEN embedding[2] >= embedding[3] THEN 1 ELSE 2 END AS label,
            ((('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT + 42) % 2147483647) % 4 = 0 AS held FROM embeddings),
        d AS (SELECT q.vec_id, t.label, sqrt(list_sum(list_transform(list_zip(q.v, t.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d, t.vec_id AS id FROM e q JOIN e t ON q.held AND NOT t.held),
        k AS (SELECT *, min(d) OVER (PARTITION BY vec_id) AS least FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, id) <= 9),
        v AS (SELECT vec_id, label, sum(CASE WHEN least = 0 THEN CAST(d = 0 AS INTEGER) ELSE 1 / d END) AS w FROM k GROUP BY 1, 2)
        SELECT vec_id, label AS y_pred FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, label) = 1""",
}

ROWS_ONLY = ("pca_variance", "lr_predict", "svm_linear_predict", "svm_rbf_predict", "rf_predict", "extra_trees_predict", "gbt_predict", "gbt_losses", "oof_predictions", "stacking_predict", "cv_summary", "predict_table", "predict_frames")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in (*ORACLES, *ROWS_ONLY)}


def oracle_sql() -> dict[str, str]:
    return ORACLES
