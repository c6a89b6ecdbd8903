"""Manifests, splits, ledgers, votes and metrics on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from skein.config import SplitConfig
from skein.functions import scalars as sc
from skein.operators import evaluate as ev
from skein.operators import ledger, manifest
from skein.sources import files, stores


@pytest.fixture(scope="module")
def tracks(spark):
    return spark.range(101).select(F.col("id").alias("track_id"), F.concat(F.lit("t"), "id").alias("path"), F.when(F.col("id") < 60, "a").when(F.col("id") < 90, "b").otherwise("c").alias("label"))


def test_split_sizes_and_partition(tracks):
    splits = manifest.stratified_split(tracks, SplitConfig())
    assert {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()} == {"val": 15, "test": 16, "train": 70}
    assert splits.select("track_id").distinct().count() == 101 and manifest.validity(splits, tracks).first()["valid"]


def test_split_without_test(tracks):
    splits = manifest.stratified_split(tracks, SplitConfig(val=0.2, test=0.0))
    assert {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()} == {"val": 21, "train": 80}


def test_folds(tracks):
    folds = manifest.stratified_folds(tracks, 5, 2).join(tracks, "track_id")
    sizes = folds.groupBy("repeat", "label", "fold").count().groupBy("repeat", "label").agg((F.max("count") - F.min("count")).alias("d"))
    assert folds.count() == 202 and all(r["d"] <= 1 for r in sizes.collect())
    with pytest.raises(ValueError):
        manifest.stratified_folds(tracks, 1)


def test_lifecycle(tracks):
    cfg = SplitConfig()
    t, s, a, b = manifest.lifecycle(None, tracks, None, cfg)
    assert a and b
    _, _, a, b = manifest.lifecycle(t, tracks, s, cfg)
    assert not a and not b
    _, _, a, b = manifest.lifecycle(t, tracks, s.where("split <> 'val'"), cfg)
    assert not a and b


def test_names(spark):
    df = spark.createDataFrame([("d", "a.mp3"), ("d", "a.wav"), ("d", "b.mp3")], "dir string, name string")
    got = {r["name"]: r["out"] for r in ledger.output_names(df).collect()}
    assert got == {"a.mp3": "a.wav", "a.wav": f"a__wav__{hashlib.md5(b'a.wav').hexdigest()[:6]}.wav", "b.mp3": "b.wav"}


def test_jobs(spark):
    df = spark.createDataFrame([("x", "x2", 1, None, None), ("y", "y2", 1, 2, 5), ("bad", "b2", 3, 2, 5)], "src string, dst string, src_mtime int, dst_mtime int, dst_size int")

    def action(src, dst):
        if src == "bad":
            raise OSError("cannot read")

    rows = ledger.run_jobs(df, action)
    assert {r["src"]: (r["status"], r["details"]) for r in rows.collect()} == {"x": ("converted", ""), "y": ("skipped", ""), "bad": ("failed", "cannot read")}
    assert {r["status"]: r["n"] for r in ledger.status_counts(rows.where("src <> 'bad'")).collect()} == {"converted": 1, "skipped": 1, "failed": 0}
    with pytest.raises(Exception, match="bad"):
        ledger.run_jobs(df, action, on_error="fail").collect()


def test_scan(spark, tmp_path):
    for name in ("a/1.mp3", "a/2.WAV", "a/x.txt", "b/0.flac"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    rows = manifest.numbered(files.labeled_files(spark, str(tmp_path), ["b", "a"]), ["b", "a"]).orderBy("track_id").collect()
    assert [(r["track_id"], r["label"], r["name"]) for r in rows] == [(0, "b", "0.flac"), (1, "a", "1.mp3"), (2, "a", "2.WAV")]
    with pytest.raises(FileNotFoundError):
        files.labeled_files(spark, str(tmp_path), ["a", "c"])
    assert files.inputs(spark, f"{tmp_path}/a/1.mp3").count() == 1


def test_numbering_splits_a_label(spark):
    found = spark.range(20_000).select(F.lit("a").alias("label"), F.concat(F.lit("n"), F.col("id") % 7000).alias("name"), F.concat(F.lit("p"), "id").alias("path"))
    rows = manifest.numbered(found, ["b", "a"])
    expected = sorted((r["name"], r["path"]) for r in found.collect())
    assert [(r["name"], r["path"]) for r in rows.orderBy("track_id").collect()] == expected
    assert [r["track_id"] for r in rows.select("track_id").orderBy("track_id").collect()] == list(range(20_000))
    placed = manifest.ranges(found, ["label", "name", "path"])
    assert placed.groupBy("_range").count().agg(F.max("count")).first()[0] < 1000


def test_splits_are_written_in_buckets(spark):
    splits = spark.range(20_000).select(F.lit("train").alias("split"), F.col("id").alias("track_id"))
    lines = stores.splits_map(splits)
    assert lines.count() == 3 and not stores.splits_rows(lines).exceptAll(splits).count() and stores.splits_rows(lines).count() == 20_000


def test_feature_store(spark, tmp_path):
    store = stores.FeatureStore(spark, str(tmp_path / "f"), "cache_key string, v int")
    calls = []

    def compute(df):
        calls.append(sorted(r["cache_key"] for r in df.collect()))
        return df.select("cache_key", F.length("cache_key").alias("v"))

    wanted = spark.createDataFrame([("a",), ("bb",)], "cache_key string")
    assert store.get(wanted.limit(1), compute).count() == 1
    assert {r["cache_key"]: r["v"] for r in store.get(wanted, compute).collect()} == {"a": 1, "bb": 2}
    assert calls == [["a"], ["bb"]]


def files_read(df):
    """How many files the only scan of a plan opened."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()


def test_store_reads_few_files_and_keeps_keys_once(spark, tmp_path):
    path = str(tmp_path / "s")
    store = stores.FeatureStore(spark, path, "cache_key string, v int")
    rows = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("cache_key"), F.col("id").cast("int").alias("v")).cache()
    store.put(rows.where("v < 2000"), "first")
    store.put(rows.where("v < 2000"), "first")  # again: nothing to do
    store.put(rows.union(rows.where("v >= 2900")), "second")  # keys that are there, and keys given twice
    assert store.jobs() == (2, ["first", "second"])
    assert store.read().count() == 3000 == store.read().select("cache_key").distinct().count()
    store.compact()
    assert store.jobs() == (3, ["compact-2"]) and not store.read().exceptAll(rows).count()
    part = F.substring(F.md5("cache_key"), 1, 2)
    wanted = rows.where(part.isin("0a", "7f", "ff")).select("cache_key")  # about one key in a hundred
    share = wanted.count() / 3000
    assert 0 < share < 0.03 and files_read(store.read(wanted)) <= 2 * share * files_read(store.read())
    assert store.get(wanted, lambda missing: 1 / 0).count() == wanted.count()


def test_store_after_a_job_that_failed(spark, tmp_path):
    """Rows without an entry in the log don't count; a job that comes second to a version looks again."""
    store = stores.FeatureStore(spark, str(tmp_path / "s"), "cache_key string, v int")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "cache_key string, v int")
    store._write(rows, "half")
    assert store.read().count() == 0 and store.jobs() == (0, [])
    other, log = stores.FeatureStore(spark, str(tmp_path / "s"), store.schema), store._log

    def late(version, jobs):
        if version == 1 and other.jobs()[0] == 0:
            other.put(rows.where("v = 1"), "other")  # comes between this job's look and its entry
        return log(version, jobs)

    store._log = late
    store.put(rows, "half")
    assert store.jobs() == (2, ["other", "half"]) and sorted(map(tuple, store.read().collect())) == [("a", 1), ("b", 2)]


def test_runs(spark, tmp_path):
    flat, nested = '{"val_acc": 0.5, "val_macro_f1": 0.4}', '{"model_type": "lr", "val": {"acc": 0.7, "macro_f1": 0.6, "balanced_acc": 0.5}}'
    for run, text, whole in (("old", flat, True), ("new", nested, True), ("half", flat, False)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.json").write_text(text)
        if whole:
            (tmp_path / run / "model_config.json").write_text("{}")
    rows = ev.leaderboard(stores.read_runs(spark, str(tmp_path)), "val_acc").collect()
    assert [(r["run"], r["val_acc"]) for r in rows] == [("new", 0.7), ("old", 0.5)]


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y_true int, y_pred int")
    m = ev.metrics(df).first()
    assert (m["acc"], round(m["macro_f1"], 6), m["balanced_acc"]) == (0.5, 0.388889, 0.5)
    labels = spark.createDataFrame([(i,) for i in range(4)], "label_idx int")
    occurring = {(r["y_true"], r["y_pred"]): r["n"] for r in ev.confusion(df).collect()}
    names = {v for r in df.collect() for v in (r["y_true"], r["y_pred"])}
    assert set(occurring) == {(a, b) for a in names for b in names} and sum(occurring.values()) == 4
    assert ev.confusion(df, labels).count() == 16 and ev.confusion(df, labels).agg(F.sum("n")).first()[0] == 4


def test_weights(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    rows = spark.createDataFrame([("a",)] * 4 + [("b",)], "label string")
    assert {r["label"]: r["weight"] for r in ev.class_weights(rows, labels).collect()} == {"a": 0.5, "b": 2.0, "c": 2.0}


def test_ci(spark):
    df = spark.createDataFrame([("x", 0.8), ("x", 0.7), ("x", 0.9), ("y", 0.4), ("z", None)], "k string, v double")
    got = {r["k"]: r for r in ev.mean_ci95(df, "v", ["k"]).collect()}
    assert got["x"]["ci95_high"] - got["x"]["mean"] == pytest.approx(0.113161, abs=1e-6)
    assert (got["y"]["ci95_low"], got["y"]["ci95_high"], got["z"]["mean"], got["z"]["n"]) == (0.4, 0.4, 0, 0)


def test_best_epoch(spark):
    df = spark.createDataFrame([("r", i + 1, f) for i, f in enumerate((0.5, 0.50005, 0.6))], "run string, epoch int, f1 double")
    assert ev.best_epoch(df).first()["best_epoch"] == 3 and ev.best_epoch(df.where("epoch < 3")).first()["best_epoch"] == 1


def test_seed(spark):
    row = spark.createDataFrame([("a/b.mp3",)], "p string").select(sc.hex_number(F.col("p")).alias("h"), sc.stable_seed(F.col("p")).alias("s")).first()
    assert (row["h"], row["s"]) == (1377027708, 1377027750)


def test_vote_and_ties(spark):
    probs = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.5), (1, 1, 0, 0.4), (1, 1, 1, 0.4)], "track_id long, seg_idx int, label_idx int, prob double")
    assert ev.track_vote(probs).first()["y_pred"] == 0


def test_splits_round_trip(tracks):
    splits = manifest.stratified_split(tracks, SplitConfig())
    back = stores.splits_rows(stores.splits_map(splits))
    assert not back.exceptAll(splits.select("split", "track_id")).count() and back.count() == 101
