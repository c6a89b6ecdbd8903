"""Votes, metrics, reports and leaderboards as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import num, three_places


def track_vote(probs: DataFrame) -> DataFrame:
    """probs(track_id, seg_idx, label_idx, prob) -> track_id, y_pred, confidence: mean over segments, then the largest (ties: the lowest index)."""
    means = probs.groupBy("track_id", "label_idx").agg(F.avg("prob").alias("prob"))
    return means.groupBy("track_id").agg(F.max_by("label_idx", F.struct("prob", -F.col("label_idx"))).alias("y_pred"), F.max("prob").alias("confidence"))


def track_truth(rows: DataFrame) -> DataFrame:
    """track_id, y_true: the label of the first segment."""
    return rows.groupBy("track_id").agg(F.min_by("label_idx", "seg_idx").alias("y_true"))


def class_weights(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """label, weight = N / (K n); an empty class counts as one row, in N as well."""
    counts = F.broadcast(labels.select("label")).join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left")
    full = counts.select("label", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n"))
    total = full.agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_k"))  # one row
    return full.join(F.broadcast(total)).select("label", "n", (F.col("_total") / (F.col("_k") * F.col("n")).cast("double")).alias("weight"))


def class_counts(preds: DataFrame) -> DataFrame:
    """label, tp, fp, fn of each class in the truth or the prediction; one pass."""
    both = preds.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = both.select(
        F.explode(F.array(
            F.struct(F.col("y_true").alias("label"), hit.alias("tp"), (F.lit(0) * F.col("n")).alias("fp"), (F.col("n") - hit).alias("fn")),
            F.struct(F.col("y_pred").alias("label"), (F.lit(0) * F.col("n")).alias("tp"), (F.col("n") - hit).alias("fp"), (F.lit(0) * F.col("n")).alias("fn")),
        )).alias("s"))
    return sides.select("s.*").groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, num(0)).otherwise(a / b)


def class_scores(preds: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return class_counts(preds).select(
        "label", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"), "tp"
    )


def metrics(preds: DataFrame) -> DataFrame:
    """One row: acc, macro_f1 (classes in truth or prediction), balanced_acc (classes in truth)."""
    return class_scores(preds).agg(
        (F.sum("tp") / F.sum("support")).alias("acc"), F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_acc")
    )


def report(preds: DataFrame) -> DataFrame:
    """A row per class, then accuracy, macro avg, weighted avg: name, precision, recall, f1, support."""
    scores = class_scores(preds)
    rows = scores.select(F.col("label").cast("string").alias("name"), "precision", "recall", "f1", "support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    names = ("precision", "recall", "f1")
    acc = scores.agg((F.sum("tp") / F.sum("support")).alias("a"), F.sum("support").alias("support"))
    out = rows.unionByName(acc.select(F.lit("accuracy").alias("name"), *[F.col("a").alias(c) for c in names], "support"))
    out = out.unionByName(scores.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("name"), *names, "support"))
    return out.unionByName(scores.agg(*[weighted(c) for c in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("name"), *names, "support"))


def confusion(preds: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """y_true, y_pred, n over all pairs of labels(label_idx); of those that occur, as truth or as prediction, if none are given."""
    if labels is None:
        labels = preds.select(F.explode(F.array("y_true", "y_pred")).alias("label_idx")).distinct()
    a, b = labels.select(F.col("label_idx").alias("y_true")), labels.select(F.col("label_idx").alias("y_pred"))
    every = a.join(b)  # labels squared
    counts = preds.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def mean_ci95(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, mean, ci95_low, ci95_high, n; one value is its own interval, none gives zeros."""
    rows = values.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    half = F.when(F.col("n") < 2, num(0)).otherwise(num(1.96) * F.col("s") / F.sqrt(F.col("n").cast("double")))
    mean = F.coalesce("m", num(0))
    return rows.select(*by, mean.alias("mean"), (mean - half).alias("ci95_low"), (mean + half).alias("ci95_high"), "n")


def leaderboard(runs: DataFrame, by: str = "test_acc") -> DataFrame:
    """runs, best first; missing values last, ties by name."""
    return runs.orderBy(F.col(by).desc_nulls_last(), F.col("run").asc())


def compare_fixed(runs: DataFrame, names: list[str], metric: str = "val_acc") -> DataFrame:
    """A row per name: the metric to three places, or N/A."""
    wanted = runs.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, run string")
    return F.broadcast(wanted).join(runs.select("run", metric), "run", "left").select("place", "run", three_places(F.col(metric)).alias("shown"))


def soft_vote(probs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """probs(model, track_id, label_idx, prob) -> track_id, label_idx, prob: the weighted mean over models."""
    w = F.lit(None).cast("double")
    for model, weight in weights.items():
        w = F.when(F.col("model") == model, num(weight)).otherwise(w)
    rows = probs.withColumn("_w", w).where("_w IS NOT NULL")
    return rows.groupBy("track_id", "label_idx").agg((F.sum(F.col("_w") * F.col("prob")) / F.sum("_w")).alias("prob"))


def meta_features(probs: DataFrame, models: list[str]) -> DataFrame:
    """track_id, features: the models' probabilities side by side, in the order of models and labels; only tracks that all have."""
    order = F.array_position(F.lit(models), F.col("model"))
    rows = probs.where(order > 0).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("m"), "label_idx", "prob"))).alias("_l"), F.countDistinct("model").alias("_k"))
    return rows.where(F.col("_k") == len(models)).select("track_id", F.transform("_l", lambda x: x["prob"]).alias("features"))


def compare_wide(predictions: DataFrame, models: list[str]) -> DataFrame:
    """predictions(model, name, label, confidence) -> name and a column per model: label (confidence)."""
    return predictions.groupBy("name").pivot("model", models).agg(F.first(F.format_string("%s (%.3f)", "label", "confidence")))


def best_epoch(history: DataFrame, min_delta: float = 1e-4, patience: int = 6, metric: str = "f1") -> DataFrame:
    """run, best_epoch, best, stopped_at (null if patience lasts): epochs in order; better means by more than min_delta."""
    start = F.struct(F.lit(None).cast("int").alias("epoch"), num(-1e300).alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("int").alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        better = x["m"] > acc["best"] + num(min_delta)
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        moved = F.struct(F.when(better, x["epoch"]).otherwise(acc["epoch"]).alias("epoch"), F.when(better, x["m"]).otherwise(acc["best"]).alias("best"), bad.alias("bad"), F.when(bad >= patience, x["epoch"]).alias("stop"))
        return F.when(acc["stop"].isNotNull(), acc).otherwise(moved)

    rows = history.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", F.col(metric).alias("m")))).alias("_h"))
    return rows.withColumn("_b", F.aggregate("_h", start, step)).select("run", F.col("_b.epoch").alias("best_epoch"), F.col("_b.best").alias("best"), F.col("_b.stop").alias("stopped_at"))
