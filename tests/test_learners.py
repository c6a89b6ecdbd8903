"""Models of our own: stored and loaded, calibrated, grown, boosted; neighbours through the index."""

import json
import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from skein.functions.scalars import softmax
from skein.operators import calibration as cal
from skein.operators import models as md
from skein.operators import trees
from skein.operators.neighbours import NeighbourIndex
from skein.sources import stores

SMALL = {
    "lr": {"iterations": 8}, "svm_linear": {"iterations": 5, "folds": 2}, "svm_rbf": {"size": 16, "iterations": 5, "folds": 2}, "svm": {"size": 16, "iterations": 5, "folds": 2}, "knn": {"k": 3},
    "rf": {"trees": 4, "depth": 3}, "extra_trees": {"trees": 3, "depth": 2}, "gbt": {"trees": 1, "depth": 2},
}
SMALL["ensemble"] = {k: v for k, v in SMALL.items() if k not in ("rf", "knn", "svm", "svm_linear")}


def frame(spark, data):
    return spark.createDataFrame(data, "id long, label_idx int, vec array<double>").withColumn("features", array_to_vector("vec"))


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes that overlap, one of them rare."""
    rng = np.random.default_rng(5)
    labels = rng.choice(3, 360, p=[0.5, 0.4, 0.1])
    return frame(spark, [(i, int(c), (rng.normal(0, 1, 4) + np.eye(4)[c] * 1.5).tolist()) for i, c in enumerate(labels)]).cache()


LOADER = """
import json, sys
from pyspark.sql import SparkSession, functions as F
from pyspark.ml.functions import array_to_vector
from skein.operators import models as md
from skein.sources import stores
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1] + "/shared").getOrCreate()
rows = spark.read.parquet(sys.argv[1] + "/rows").withColumn("features", array_to_vector("vec"))
out = {}
for name in sys.argv[2:]:
    model, config = stores.load_model(spark, f"{sys.argv[1]}/live/{name}")
    out[name] = [config["labels"], config["name"], [list(r["probs"]) for r in md.predict(model, rows, ["id"]).orderBy("id").collect()]]
print(json.dumps(out))
"""


def test_all_models_are_stored_promoted_and_loaded(spark, rows, tmp_path):
    """In another process: nothing but the folder is shared."""
    where, want = str(tmp_path), {}
    asked = rows.where("id % 9 = 0")
    asked.select("id", "vec").write.parquet(f"{where}/rows")
    for name in md.NAMES:
        model = md.fit(name, rows.where("id < 150"), **SMALL[name])
        stores.save_model(model, f"{where}/runs/{name}", ["a", "b", "c"], {"name": name}, {"acc": 0.5})
        stores.promote(spark, f"{where}/runs/{name}", f"{where}/live/{name}")
        want[name] = [list(r["probs"]) for r in md.predict(model, asked, ["id"]).orderBy("id").collect()]
    assert len(want) == 9
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    ran = subprocess.run([sys.executable, "-c", LOADER, where, *want], env=env, capture_output=True, text=True, timeout=600, check=True)
    got = json.loads(ran.stdout.strip().splitlines()[-1])
    for name, probs in want.items():
        labels, stored_name, other = got[name]
        assert labels == ["a", "b", "c"] and stored_name == name and np.array(other) == pytest.approx(np.array(probs), abs=1e-9), name
    stores.save_model(md.fit("knn", rows, k=1), f"{where}/live/knn", ["a", "b", "c"], {})  # a model replaces the one before
    loaded, _ = stores.load_model(spark, f"{where}/live/knn")
    assert md.predict(loaded, rows, ["id", "label_idx"]).where("y_pred = label_idx").count() == 360


def log_loss(probs, labels):
    return -float(np.log(np.maximum(np.array(probs)[np.arange(len(labels)), labels], 1e-300)).mean())


def test_calibrated_probabilities(rows):
    """On rows not learnt from, sigmoids of out-of-fold margins beat the softmax of margins."""
    held = rows.where("id % 3 = 0")
    for name in ("svm_linear", "svm_rbf"):
        model = md.fit(name, rows.where("id % 3 <> 0"), iterations=20)
        out = model.transform(held).select("label_idx", "probability", vector_to_array("rawPrediction").alias("m")).withColumn("s", softmax(F.col("m"))).collect()
        labels = [r["label_idx"] for r in out]
        assert all(sum(r["probability"]) == pytest.approx(1) for r in out)
        assert log_loss([r["probability"].toArray() for r in out], labels) < log_loss([r["s"] for r in out], labels)


def test_sigmoids_are_the_best_ones(spark):
    """Nothing nearby has a lower loss; a class that margins tell apart, and one that never occurs, get finite values."""
    rng = np.random.default_rng(0)
    data = [(int(y := rng.integers(3)), [float(3 * (y == 0) - 1 + rng.normal()), float(2 * (y == 1) - 1), float(rng.normal()), -1.0]) for _ in range(400)]
    a, b = cal.sigmoids(spark.createDataFrame(data, "label_idx int, margins array<double>").cache())
    y, m = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    for c in range(4):
        own = (y == c).sum()
        t = np.where(y == c, (own + 1) / (own + 2), 1 / (len(y) - own + 2))

        def loss(p, q, c=c, t=t):
            f = p * m[:, c] + q
            return float((t * f + np.logaddexp(0, -f)).sum())

        assert math.isfinite(a[c]) and all(loss(a[c], b[c]) <= loss(a[c] + d, b[c] + e) + 1e-7 for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))
    assert a[0] < 0 and a[1] < -2 and abs(a[2]) < 0.3


def test_machines_are_the_best_ones(spark):
    """No direction away from the coefficients lowers the penalised loss; folds' machines don't see their fold."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(150, 3)), rng.integers(0, 2, 150)
    x[:, 0] += 1.5 * y
    df = frame(spark, [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))]).withColumn("weight", F.lit(0.5) + F.col("label_idx"))
    machines = cal.CalibratedMachines("features", c=2.0, iterations=200)
    got = sorted(machines.fit(df).tables["machines"].collect())
    weight = 0.5 + y

    def loss(w, b, sign):
        short = 1 - sign * (x @ w + b)
        bend = np.clip((short + 0.05) / 0.1, 0, 1)
        return (weight * np.where(bend < 1, 0.05 * bend**2, short)).sum() * 2.0 + (w @ w) / 2

    for c in range(2):
        w, b, sign = np.array(got[c]["weights"]), got[c]["intercept"], np.where(y == c, 1, -1)
        least = loss(w, b, sign)
        for _ in range(200):
            assert loss(w + rng.normal(0, 0.02, 3), b + rng.normal(0, 0.02), sign) > least - 1e-3 * abs(least)


def test_machines_of_classes_that_lack_rows(spark):
    data = [(i, 0 if i < 30 else 2, [float(i % 7), float(i)]) for i in range(31)]  # class 1 has no row, class 2 one
    got = md.predict(md.fit("svm_linear", frame(spark, data), folds=3), frame(spark, data), ["id", "label_idx"]).collect()
    assert all(len(r["probs"]) == 3 and sum(r["probs"]) == pytest.approx(1) for r in got) and sum(r["y_pred"] == r["label_idx"] for r in got) >= 30
    with pytest.raises(ValueError, match="no rows"):
        cal.CalibratedMachines("features").fit(md.balanced(frame(spark, data).where("1 = 0")))


def grown_by_hand(x, y, w, classes, tree, depth, min_leaf, seed):
    """One extremely randomised tree by recursion: the shares of each leaf, by row."""
    out, m = np.zeros((len(x), classes)), max(1, int(math.sqrt(x.shape[1])))

    def grow(own, path, level):
        shares = np.bincount(y[own], w[own], classes)
        best = None
        if level < depth and len(own) >= 2 * min_leaf and (shares > 0).sum() > 1:
            node = np.array([tree]), np.array([path])
            features = trees.drawn_features(seed, *node, x.shape[1], m)
            low, high = x[own][:, features[0]].min(axis=0)[None], x[own][:, features[0]].max(axis=0)[None]
            for s, (f, t) in enumerate(zip(features[0], trees.drawn_thresholds(seed, *node, features, low, high)[0], strict=True)):
                right = x[own, f] > t
                if min_leaf <= right.sum() <= len(own) - min_leaf:
                    sides = [np.bincount(y[own[k]], w[own[k]], classes) for k in (~right, right)]
                    gain = sum((q * q).sum() / q.sum() for q in sides)
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, s, own[~right], own[right]
        if best is None:
            out[own] = shares / shares.sum()
        else:
            grow(best[2], 2 * path, level + 1)
            grow(best[3], 2 * path + 1, level + 1)

    grow(np.arange(len(x)), 1, 0)
    return out


@pytest.mark.parametrize(("depth", "min_leaf", "group"), [(6, 2, 64), (3, 20, 1)])
def test_extra_trees_match_brute_force(spark, depth, min_leaf, group):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(200, 9)), 1)
    x[:, 4] = 1.0  # nothing to split there
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)).astype(int)
    df = md.balanced(frame(spark, [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))]).repartition(3))
    model = trees.ExtraTrees("features", trees=3, depth=depth, min_leaf=min_leaf, group=group).fit(df)
    weight = {r["label_idx"]: r["weight"] for r in df.select("label_idx", "weight").distinct().collect()}
    want = np.mean([grown_by_hand(x, y, np.array([weight[c] for c in y]), 3, t, depth, min_leaf, 42) for t in range(3)], axis=0)
    got = np.array([r["probability"].toArray() for r in model.transform(df).orderBy("id").collect()])
    assert got == pytest.approx(want, abs=1e-9)
    nodes = model.tables["nodes"]
    assert nodes.where("feature = 4").count() == 0 and nodes.select("tree").distinct().count() == 3


def test_forest_of_one_class_or_row(spark):
    one = md.balanced(frame(spark, [(1, 1, [0.5])]))
    got = trees.ExtraTrees("features", trees=2).fit(one).transform(one).first()["probability"].toArray()
    assert got.tolist() == [0, 1]
    got = trees.Boosted("features", rounds=2, depth=2).fit(one).transform(one).first()["probability"].toArray()
    assert got == pytest.approx([0.5, 0.5])


def test_boosting_lowers_the_loss_every_round_and_beats_one_against_the_rest(rows):
    df = md.balanced(rows)
    model = trees.Boosted("features", rounds=12, depth=3, rate=0.3, refresh=5).fit(df)
    losses = model.values["losses"]
    assert len(losses) == 13 and losses[0] == pytest.approx(math.log(3)) and all(b < a for a, b in zip(losses, losses[1:], strict=False))
    labels = [r["label_idx"] for r in df.orderBy("id").collect()]
    weights = np.array([r["weight"] for r in df.orderBy("id").collect()])
    probs = np.array([r["probability"].toArray() for r in model.transform(df).orderBy("id").collect()])
    mine = -np.log(probs[np.arange(len(labels)), labels])
    assert (mine * weights).sum() / weights.sum() == pytest.approx(losses[-1])
    rest = OneVsRest(classifier=GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=42), labelCol="label_idx", weightCol="weight").fit(df)
    other = np.array([r["s"] for r in rest.transform(df).withColumn("s", softmax(vector_to_array("rawPrediction"))).orderBy("id").collect()])
    assert (mine * weights).sum() < (-np.log(other[np.arange(len(labels)), labels]) * weights).sum()


def test_one_boosted_leaf_value(spark):
    """Two separate groups, one round: a leaf holds -rate * g / (h + l2) of its rows."""
    df = frame(spark, [(i, i % 2, [float(i % 2)]) for i in range(40)]).withColumn("weight", F.lit(1.0))
    model = trees.Boosted("features", rounds=1, depth=1, rate=0.1, l2=5.0).fit(df)
    value = 0.1 * 20 * 0.5 / (20 * 0.25 + 5)
    want = 1 / (1 + math.exp(-2 * value))
    assert [r["probability"][r["label_idx"]] for r in model.transform(df).collect()] == pytest.approx([want] * 40)


def brute(known, asked, k):
    out = {}
    for q, v in asked:
        d = np.sqrt(((np.array([x for _, _, x in known]) - v) ** 2).sum(axis=1))
        out[q] = [(float(d[j]), known[j][0]) for j in sorted(range(len(known)), key=lambda j: (d[j], known[j][0]))[:k]]
    return out


@pytest.mark.parametrize(("pivots", "ring_rows", "block"), [(None, 1024, 2000), (None, 20, 30), (12, 30, 20), (1, 10, 7), (40, 5, 500)])
def test_index_matches_brute_force(spark, pivots, ring_rows, block):
    """Clusters, a third of all rows in one place, many ties, and queries far from everything."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 20, (8, 3))
    known = [(i, i % 3, np.round(centres[i % 8] + rng.normal(0, 1, 3), 1).tolist() if i % 3 else [1.0, 1.0, 1.0]) for i in range(600)]
    asked = [(100 + i, np.round(centres[i % 8] + rng.normal(0, 1, 3), 1).tolist()) for i in range(50)] + [(1, [1.0, 1.0, 1.0]), (2, [500.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0])]
    index = NeighbourIndex(spark.createDataFrame(known, "id long, label_idx int, vec array<double>").repartition(3), pivots, ring_rows, block)
    for k in (1, 7, 250):
        got = {r["key"]: [(n["d"], n["id"]) for n in r["best"]] for r in index.search(spark.createDataFrame(asked, "key long, vec array<double>"), k).collect()}
        want = brute(known, asked, k)
        assert got.keys() == want.keys() and all([i for _, i in got[q]] == [i for _, i in want[q]] and [d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]]) for q in want)


def test_index_compares_few_pairs_on_clustered_rows(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 10, (40, 8))
    known = [(i, 0, (centres[i % 40] + rng.normal(0, 1, 8)).tolist()) for i in range(4000)]
    asked = [(i, (centres[i % 40] + rng.normal(0, 1, 8)).tolist()) for i in range(400)]
    index = NeighbourIndex(spark.createDataFrame(known, "id long, label_idx int, vec array<double>"), pivots=80, ring_rows=64)
    queries = spark.createDataFrame(asked, "key long, vec array<double>").cache()
    got = index.search(queries, 9).cache()
    want = brute(known, asked[:40], 9)
    assert all([n["id"] for n in r["best"]] == [i for _, i in want[r["key"]]] for r in got.where("key < 40").collect())
    reach = queries.join(got.select("key", F.element_at("best", -1)["d"].alias("reach")), "key")
    # An upper bound of what a search compares: the second round is counted with the final reach plus all of the first round.
    pairs = index.pairs(index._visits(queries, 9, False)) + index.pairs(index._visits(reach, 9, True))
    assert pairs < 4000 * 400 / 5


def test_fold_bank_gives_the_same_metrics(spark, rows):
    """Means and deviations by subtraction, folds side by side, one look at the source."""
    from pyspark.ml import Pipeline

    from skein.operators import evaluate as ev

    looked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        looked.add(1)
        return x

    source = rows.withColumn("first", seen(F.element_at("vec", 1))).select("id", "label_idx", array_to_vector(F.concat(F.array("first"), F.slice("vec", 2, 3), F.array(F.lit(7.0)))).alias("features"))
    folds = md.folds(rows, "id", 3, repeats=2)
    got = {r["metric"]: r for r in md.cross_validate(source, folds, lambda: md.build("lr", iterations=15), "id").collect()}
    assert looked.value == 360
    plain = rows.select("id", "label_idx", array_to_vector(F.concat("vec", F.array(F.lit(7.0)))).alias("features")).join(folds, "id").cache()
    for (repeat, fold), (mean, std) in md.fold_stats(plain).items():
        x = np.array([r["features"].toArray() for r in plain.where(f"repeat = {repeat} AND fold <> {fold}").collect()])
        assert mean == pytest.approx(x.mean(axis=0)) and std == pytest.approx(x.std(axis=0)) and std[-1] == 0
    values = []
    for repeat in range(2):
        for fold in range(3):
            own = plain.where(f"repeat = {repeat}")
            model = md.build("lr", iterations=15).fit(md.balanced(own.where(f"fold <> {fold}")))
            held = md.predict(model, own.where(f"fold = {fold}"), ["label_idx"]).select(F.col("label_idx").alias("y_true"), "y_pred")
            values.append(ev.metrics(held).first()["acc"])
    assert got["acc"]["n"] == 6 and got["acc"]["mean"] == pytest.approx(np.mean(values), abs=0.01)
    hook = md.cross_validate(rows.select("id", "label_idx", "features"), folds.where("repeat = 0"), lambda: Pipeline(stages=[md.Logistic("features", iterations=5)]), "id")
    assert {r["n"] for r in hook.collect()} == {3}  # any estimator will do


def test_prediction_from_frames(spark, tmp_path):
    """A model that starts at frames is stored with its settings; others are refused."""
    from skein.config import IntervalConfig

    cfg = IntervalConfig(segment_length=10, segments=2)
    rng = np.random.default_rng(1)
    data = [(t, i, float(220 * 2 ** (rng.choice([0] if t % 2 else [1, 6, 9]) / 12)), True, float(rng.random()), 4.0, 1.0) for t in range(24) for i in range(30)]
    frames = spark.createDataFrame(data, "track_id long, frame_idx long, f0_hz double, voiced_flag boolean, energy double, h_power double, p_power double").cache()
    labels = spark.range(24).select(F.col("id").alias("track_id"), (F.col("id") % 2).cast("int").alias("label_idx"))
    model = md.fit_frames("lr", frames.where("track_id < 16"), labels, cfg, iterations=10)
    stores.save_model(model, str(tmp_path / "m"), ["even", "odd"], {"signature": cfg.signature()})
    loaded, config = stores.load_model(spark, str(tmp_path / "m"))
    got = md.predict_frames(frames, loaded, config["labels"], 5, cfg).collect()
    assert loaded.stages[0].config == cfg and len(got) == 48
    assert sum(r["label"] == ("odd" if r["track_id"] % 2 else "even") for r in got if r["place"] == 0 and r["track_id"] >= 16) >= 7
    assert sorted(map(tuple, got)) == sorted(map(tuple, md.predict_frames(frames, model, ["even", "odd"], 2).collect()))
    with pytest.raises(ValueError, match="settings"):
        md.predict_frames(frames, loaded, ["even", "odd"], 1, IntervalConfig())
    with pytest.raises(ValueError, match="ready features"):
        md.predict_frames(frames, loaded.stages[1], ["even", "odd"], 1)
