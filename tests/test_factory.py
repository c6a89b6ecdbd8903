"""The model factory, track-level cross-validation, neighbours, the v1 vector, and stores."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from skein.operators import models as md
from skein.operators import signals as sg
from skein.sources import stores

SMALL = {"lr": {"iterations": 10}, "rf": {"trees": 5, "depth": 4}, "extra_trees": {"trees": 5, "depth": 4}, "gbt": {"trees": 1, "depth": 2}, "svm_rbf": {"size": 64, "iterations": 8}, "knn": {"k": 5}}
SMALL["ensemble"] = {k: v for k, v in SMALL.items() if k not in ("rf", "knn")}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, i // 4, i % 4, i // 4 % 3, (rng.normal(0, 1, 5) + np.eye(5)[i // 4 % 3] * 6).tolist()) for i in range(240)]
    return spark.createDataFrame(data, "id long, track_id long, seg_idx int, label_idx int, vec array<double>").withColumn("features", array_to_vector("vec")).cache()


@pytest.mark.parametrize("name", ["svm_rbf", "knn", "ensemble"])
def test_models_of_several_parts(rows, name):
    got = md.predict(md.fit(name, rows.where("id % 5 <> 0"), **SMALL.get(name, {})), rows.where("id % 5 = 0"), ["id", "label_idx"]).collect()
    assert len(got) == 48 and sum(r["y_pred"] == r["label_idx"] for r in got) >= 44
    assert all(sum(r["probs"]) == pytest.approx(1, abs=1e-6) for r in got)


def test_components_and_scaler(rows):
    model = md.fit("lr", rows, share=0.9)
    out = model.transform(rows)
    scaled = np.array([r["_scaled"].toArray() for r in out.select("_scaled").collect()])
    assert scaled.mean(axis=0) == pytest.approx(np.zeros(5), abs=1e-9) and scaled.std(axis=0) == pytest.approx(np.ones(5))
    assert 1 <= len(out.first()["_scaled_pca"]) < 5
    with pytest.raises(ValueError):
        md.build("none")


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    train, asked = rng.integers(0, 4, (300, 3)).astype(float), rng.integers(0, 4, (70, 3)).astype(float)  # many ties
    t = spark.createDataFrame([(i, int(i % 3), x.tolist()) for i, x in enumerate(train)], "id long, label_idx int, vec array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "q long, vec array<double>")
    got = {r["q"]: r["y_pred"] for r in md.knn(t, q, "q", 7, part=40, block=25).collect()}
    for i, x in enumerate(asked):
        d = np.sqrt(((train - x) ** 2).sum(axis=1))
        best = sorted(range(300), key=lambda j: (d[j], j))[:7]
        zero = d[best[0]] == 0
        w = [sum((1.0 if d[j] == 0 else 0.0) if zero else 1 / d[j] for j in best if j % 3 == c) for c in range(3)]
        assert got[i] in [c for c in range(3) if w[c] > max(w) - 1e-9]
    assert md.knn(t.where("1 = 0"), q, "q").count() == 0


def test_cross_validation_counts_tracks(rows):
    """One segment in four lies: rows score at most 3 in 4, the tracks' votes are right."""
    lying = rows.withColumn("vec", F.when(F.col("seg_idx") == 0, F.array(*[F.lit(0.0)] * 5)).otherwise(F.col("vec"))).withColumn("features", array_to_vector("vec"))
    folds = md.folds(rows.select("track_id", "label_idx").distinct(), "track_id", 3)
    got = {r["metric"]: r for r in md.cross_validate(lying, folds, lambda: md.build("lr"), "track_id", train_bank=rows).collect()}
    assert set(got) == {"acc", "macro_f1", "balanced_acc"} and got["acc"]["n"] == 3 and got["acc"]["mean"] > 0.95


def test_stack_and_batch_predictions(rows):
    folds = md.folds(rows, "id", 3).select("id", "fold")
    stack = md.Stack(rows, folds, ["lr", "rf"], "id", SMALL)
    got = stack.predict(rows).join(rows.select("id", "label_idx"), "id")
    assert got.where("y_pred = label_idx").count() >= 230
    segments = rows.select("track_id", "seg_idx", "features", F.lit("s").alias("cfg_sig"))
    named = md.predict_series(segments, md.fit("lr", rows), ["a", "b", "c"], 2, "s").collect()
    assert len(named) == 120 and all(r["label"] == "abc"[r["track_id"] % 3] for r in named if r["place"] == 0)
    with pytest.raises(Exception, match="other settings"):
        md.predict_series(segments, md.fit("lr", rows), ["a", "b", "c"], 2, "t").collect()


def test_v1_vector(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, 22050, rng.normal(size=400).tolist()) for i in range(2)], "series_id long, sample_rate int, samples array<double>")
    spectrum = sg.power_spectrum(sg.frame_signal(df, 64, 16), 64).cache()
    mode = spark.createDataFrame([(0, "pitch", 3, 0.5)], "series_id long, feature string, idx int, value double")
    rows = sg.segment_vector(spectrum, spectrum, 22050, 64, [4, 12], bands=10, coefficients=6, mode=mode).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r["series_id"], r["feature"]), []).append(r["idx"])
    assert {k: len(v) for k, v in sizes.items() if k[0] == 1} == {(1, "mel"): 20, (1, "mfcc"): 12, (1, "delta"): 12, (1, "chroma"): 24, (1, "contrast"): 6, (1, "tonnetz"): 12}
    assert all(sorted(v) == list(range(len(v))) for k, v in sizes.items() if k[1] != "pitch") and sizes[0, "pitch"] == [3]
    ceps = {}
    for r in sg.mfcc(sg.mel_db(spectrum, 22050, 64, 10), 10, 6).where("series_id = 1").orderBy("o", "frame_idx").collect():
        ceps.setdefault(r["o"], []).append(r["value"])
    got = {(r["feature"], r["idx"]): r["value"] for r in rows if r["series_id"] == 1}
    for o, x in ceps.items():
        x = np.array(x)
        slope = np.array([sum(k * (x[i + k] - x[i - k]) for k in range(1, 5)) / 60 for i in range(4, len(x) - 4)])
        slope = np.concatenate([[slope[0]] * 4, slope, [slope[-1]] * 4])
        assert got["mfcc", o] == pytest.approx(x.mean()) and got["mfcc", o + 6] == pytest.approx(x.std())
        assert got["delta", o] == pytest.approx(slope.mean()) and got["delta", o + 6] == pytest.approx(slope.std())


def test_stores(spark, rows, tmp_path):
    where = str(tmp_path)
    tracks = spark.createDataFrame([(1, "a/x.mp3", "a"), (2, "b/é.wav", "b")], stores.MANIFEST)
    for as_json in (False, True):
        stores.write_manifest(tracks, f"{where}/m{as_json}", as_json)
        assert stores.read_manifest(spark, f"{where}/m{as_json}", as_json).orderBy("track_id").collect() == tracks.collect()
    stores.save_model(md.fit("lr", rows), f"{where}/run", ["a", "b", "c"], {"share": None}, {"acc": 0.5})
    stores.promote(spark, f"{where}/run", f"{where}/live")
    model, config = stores.load_model(spark, f"{where}/live")
    assert config["labels"] == ["a", "b", "c"] and md.predict(model, rows, ["id"]).count() == 240
    with pytest.raises(FileNotFoundError):
        stores.promote(spark, f"{where}/none", f"{where}/live2")
    preds = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y_true int, y_pred int")
    stores.write_evaluation(preds, spark.range(2).select(F.col("id").cast("int").alias("label_idx")), f"{where}/eval")
    assert spark.read.json(f"{where}/eval/metrics").first()["acc"] == pytest.approx(2 / 3)
    assert {(r["y_true"], r["y_pred"]): r["n"] for r in spark.read.json(f"{where}/eval/confusion").collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 1}
    assert any("weighted avg" in r["value"] for r in spark.read.text(f"{where}/eval/report").collect())
    stores.write_predictions(spark.createDataFrame([("x", "a", 0.5)], "name string, label string, confidence double"), f"{where}/p")
    assert spark.read.json(f"{where}/p").count() == 1
