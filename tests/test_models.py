"""Classifiers beat the majority class on planted labels; signals meet their definitions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from skein.functions import scalars as sc
from skein.operators import models as md
from skein.operators import prep
from skein.operators import signals as sg


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 5))
    rows = [(i, int(np.argmax(v[:3])), [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, label_idx int, vec array<double>").withColumn("features", array_to_vector("vec"))
    return df.where("id % 4 <> 0").cache(), df.where("id % 4 = 0").cache()


def accuracy(preds):
    return preds.agg(F.avg((F.col("y_pred") == F.col("label_idx")).cast("double"))).first()[0]


@pytest.mark.parametrize("name", ["lr", "svm_linear", "rf"])
def test_models(planted, name):
    train, test = planted
    options = {"trees": 15, "depth": 5} if name == "rf" else {"iterations": 15}
    got = md.predict(md.fit(name, train, **options), test, ["id", "label_idx"])
    assert accuracy(got) > 0.6 and got.select(F.abs(sc.total(F.col("probs")) - 1).alias("e")).agg(F.max("e")).first()[0] < 1e-6


def test_knn(planted):
    train, test = planted
    got = {r["id"]: r["y_pred"] for r in md.knn(train.select("id", "label_idx", "vec"), test.select("id", "vec"), "id", 5, part=50).collect()}
    known = [(r["id"], r["label_idx"], np.array(r["vec"])) for r in train.collect()]
    for r in test.collect():
        d = sorted((float(np.sqrt(((np.array(r["vec"]) - v) ** 2).sum())), i, y) for i, y, v in known)[:5]
        votes = {}
        for dist, _, y in d:
            votes[y] = votes.get(y, 0) + 1 / dist
        assert got[r["id"]] == max(votes, key=lambda y: (votes[y], -y))


def test_out_of_fold_has_no_leak(planted):
    train, _ = planted
    folds = md.folds(train, "id", 3).select("id", "fold")
    oof = md.out_of_fold(train, folds, ["lr"], "id", {"lr": {"iterations": 5}})
    assert oof.count() == train.count() == oof.select("id").distinct().count()


def test_unknown_model():
    with pytest.raises(ValueError):
        md.build("nothing")


def test_power_spectrum(spark):
    x = np.random.default_rng(2).normal(size=8)
    frames = spark.createDataFrame([(1, 0, x.tolist())], "series_id long, frame_idx int, frame array<double>")
    got = [r["value"] for r in sg.power_spectrum(frames, 8, "none").orderBy("bin").collect()]
    assert got == pytest.approx(list(np.abs(np.fft.rfft(x)) ** 2))


def test_short_signal_is_padded(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "series_id long, samples array<double>")
    assert sg.frame_signal(df, 4, 2).first()["frame"] == [1.0, 2.0, 0.0, 0.0]


def test_yin_finds_a_sine(spark):
    rate, hz = 8000, 200.0
    x = np.sin(2 * np.pi * hz * np.arange(400) / rate)
    df = spark.createDataFrame([(1, 0, rate, x.tolist())], "series_id long, frame_idx int, sample_rate int, frame array<double>")
    row = sg.yin(df, 80, 800).first()
    assert row["voiced_flag"] and row["f0_hz"] == pytest.approx(hz, rel=0.02)


def test_matrices():
    d = sg.dct_matrix(6, 6)
    assert d @ d.T == pytest.approx(np.eye(6))
    assert sg.mel_matrix(22050, 512, 20, 20, 8000).shape == (20, 257) and sg.chroma_matrix(22050, 64).sum() == 32


def test_prep(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    row = df.select(prep.pad_or_cut(F.col("x"), 5).alias("a"), prep.pad_or_cut(F.col("x"), 2).alias("b"), prep.block_mask(F.col("x"), 2, F.lit("k")).alias("c")).first()
    assert row["a"] == [1, 2, 3, 0, 0] and row["b"] == [1, 2] and sum(v == 0 for v in row["c"]) <= 2


def test_matrices(spark):
    m = np.arange(1.0, 13.0).reshape(3, 4)
    df = spark.createDataFrame([(str(k), m.tolist()) for k in range(40)] + [("empty", [])], "k string, m array<array<double>>")
    made = df.select("k", prep.scale_matrix(F.col("m")).alias("z"), prep.crop_frames(F.col("m"), F.lit(2), 3).alias("c"), prep.attach_rows(F.col("m"), F.array(F.lit(5.0), F.lit(6.0))).alias("a"),
                     prep.mask_frames(F.col("m"), 2, F.col("k")).alias("f"), prep.mask_bins(F.col("m"), 9, F.col("k")).alias("b")).collect()
    frames, bins = set(), set()
    for r in made:
        if r["k"] == "empty":
            assert r["z"] == r["c"] == r["f"] == r["b"] == [] and r["a"] == [[], []]
            continue
        assert np.array(r["z"]) == pytest.approx((m - m.mean()) / (m.std() + 1e-6)) and r["c"] == [[3, 4, 0], [7, 8, 0], [11, 12, 0]] and r["a"] == [*m.tolist(), [5.0] * 4, [6.0] * 4]
        for got, axis, seen in ((np.array(r["f"]), 0, frames), (np.array(r["b"]), 1, bins)):
            gone = np.flatnonzero((got == 0).all(axis=axis))
            assert ((got == m) | (got == 0)).all() and len(gone) * m.shape[axis] == (got == 0).sum() and (len(gone) == 0 or gone[-1] - gone[0] + 1 == len(gone))
            seen.add(len(gone))
    assert frames == {0, 1, 2} and bins == {0, 1, 2, 3}


def test_balanced_sample(spark):
    rows = spark.range(300).select(F.col("id"), F.when(F.col("id") < 270, "big").otherwise("small").alias("label"))
    got = {r["label"]: r["count"] for r in prep.balanced_sample(rows, "id").groupBy("label").count().collect()}
    assert sum(got.values()) == 300 and 110 < got["small"] < 190
