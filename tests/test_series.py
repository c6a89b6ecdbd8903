"""Worked examples of the series operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skein.config import IntervalConfig, ModeConfig, SplitConfig
from skein.operators import intervals as iv
from skein.operators import series

CLASSES = [2, 2, 2, 9, 9, 2, 2, 16, 16, 16, 2, 2]
CFG = IntervalConfig()


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(1, 0, i, pc) for i, pc in enumerate(CLASSES)]
    df = spark.createDataFrame(rows, "track_id long, seg_idx int, frame_idx long, pc int")
    return df.withColumn("tail", series.in_tail(0.15))


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r["n"] for r in df.collect()}


def test_tonic_and_tail(notes):
    assert notes.where("tail").count() == 2
    one = iv.tonics(notes).first()
    assert one["tonic"] == 2 and one["tonic_strength"] == pytest.approx(0.625)


def test_histograms(notes):
    itv = iv.intervals(notes, CFG)
    assert as_dict(iv.histogram(itv, "itv"), "itv") == {0: 7, 7: 2, 14: 3}
    assert as_dict(iv.transitions(itv), "previous", "itv") == {(0, 0): 4, (0, 7): 1, (7, 7): 1, (7, 0): 1, (0, 14): 1, (14, 14): 2, (14, 0): 1}
    assert as_dict(iv.steps(itv), "step") == {0: 7, 7: 1, -7: 1, -10: 1, 10: 1}
    assert sorted(r["length"] for r in iv.runs(itv).collect()) == [2, 2, 2, 3, 3]
    assert as_dict(iv.durations(itv), "bucket") == {1: 3, 2: 2}
    assert as_dict(iv.cadences(itv), "itv") == {0: 2}
    s = itv.agg(F.avg(F.abs("step")) / 12, F.stddev_pop("step") / 12).first()
    assert s[0] == pytest.approx(0.257576, abs=1e-6) and s[1] == pytest.approx(0.433741, abs=1e-6)


def test_histograms_sum_to_one(notes):
    itv = iv.intervals(notes, CFG)
    for h in (iv.histogram(itv, "itv"), iv.transitions(itv), iv.cadences(itv), iv.steps(itv), iv.durations(itv)):
        assert h.agg(F.sum("value")).first()[0] == pytest.approx(1)


def test_single_note(spark):
    one = spark.createDataFrame([(1, 0, 0, 5, True)], "track_id long, seg_idx int, frame_idx long, pc int, tail boolean")
    itv = iv.intervals(one, CFG)
    assert as_dict(iv.steps(itv), "step") == {0: 1} and iv.transitions(itv).count() == 0
    assert iv.tonics(one).first()["tonic_strength"] == pytest.approx(1)


def test_short_runs(spark):
    mask = [True, True, False, True, True, True, False, False, True]
    df = spark.createDataFrame([(1, 0, i, v) for i, v in enumerate(mask)], "track_id long, seg_idx int, frame_idx long, v boolean")
    got = [r["voiced"] for r in series.suppress_short_runs(df, "v", "voiced", 3).orderBy("frame_idx").collect()]
    assert got == [False] * 3 + [True] * 3 + [False] * 3
    assert [r["voiced"] for r in series.suppress_short_runs(df, "v", "voiced", 1).orderBy("frame_idx").collect()] == mask


def test_even_starts(spark):
    lens = spark.createDataFrame([(1, 67), (2, 20), (3, 5)], "track_id long, n long")
    got = {}
    for r in series.even_starts(lens, 20, 4).orderBy("track_id", "seg_idx").collect():
        got.setdefault(r["track_id"], []).append(r["start"])
    assert got == {1: [0, 15, 31, 47], 2: [0], 3: [0]}
    assert [r["start"] for r in series.even_starts(lens.where("n = 67"), 20, 1).collect()] == [23]


def test_duration_buckets(spark):
    lengths = [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13]
    edges = iv.DURATION_EDGES
    assert [sum(e < x for e in edges) for x in lengths] == [0, 1, 2, 3, 4, 4, 5, 5, 6, 6, 7]


def test_gate(spark):
    def segment(voiced):
        rows = [(1, 0, i, 220.0, i < voiced, 4.0, 1.0) for i in range(100)]
        return spark.createDataFrame(rows, "track_id long, seg_idx int, frame_idx long, f0_hz double, voiced boolean, h_power double, p_power double")

    assert not iv.gate(segment(29), CFG).first()["pitched"] and iv.gate(segment(30), CFG).first()["pitched"]
    gated = {r["idx"]: r["value"] for r in iv.profile(segment(29), CFG).collect()}
    assert gated[0] == pytest.approx(0.29) and gated[1] == pytest.approx(2 / 3) and all(gated[i] == 0 for i in range(2, 8))


def test_pooling(spark):
    """The mean over pitched segments, over all of them if none is; what a segment lacks is 0 there."""

    def pooled(flags):
        rows = [(1, i, bool(flag), "hist", 0, v) for i, (flag, v) in enumerate(zip(flags, (2.0, 9.0, 4.0), strict=True))]
        rows += [(1, i, bool(flag), "scalar", j, 0.25 * (i + 1 + j)) for i, flag in enumerate(flags) for j in range(2)] + [(1, 0, bool(flags[0]), "step", 3, 6.0)]
        features = spark.createDataFrame(rows, "track_id long, seg_idx int, pitched boolean, feature string, idx int, value double")
        return {(r["feature"], r["idx"]): r["value"] for r in iv.pool(features).collect()}

    some, none = pooled((1, 0, 1)), pooled((0, 0, 0))
    assert some["hist", 0] == pytest.approx(3) and none["hist", 0] == pytest.approx(5)
    assert some["step", 3] == pytest.approx(3) and none["step", 3] == pytest.approx(2)
    assert [some["track", i] for i in range(3)] == pytest.approx([2 / 3, 0.5, 0.75]) and none["track", 0] == 0


@pytest.mark.parametrize("half", [0, 1, 4, 40])
def test_sliding_median(spark, half):
    rng = np.random.default_rng(half)
    series_of = {k: [None if v < -1.2 else round(float(v), 1) for v in rng.normal(size=n)] for k, n in (("a", 60), ("b", 1), ("c", 7))} | {"n": [None, None]}
    rows = [(k, i, v, "extra") for k, values in series_of.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, i int, v double, other string").repartition(3)
    got = {(r["k"], r["i"]): r["m"] for r in series.moving_median(df, "v", "m", half, ["k"], "i").collect()}
    for k, values in series_of.items():
        for i in range(len(values)):
            near = [v for v in values[max(0, i - half) : i + half + 1] if v is not None]
            assert got[k, i] == (pytest.approx(float(np.median(near))) if near else None)
    assert series.moving_median(df, "v", "m", half, ["k"], "i").columns == ["k", "i", "v", "other", "m"]


def test_track_without_frames_is_zeros(spark):
    frames = spark.createDataFrame([(1, i, 220.0 + i % 3, True, 1.0, 4.0, 1.0) for i in range(60)], "track_id long, frame_idx long, f0_hz double, voiced_flag boolean, energy double, h_power double, p_power double")
    tracks = spark.createDataFrame([(1,), (2,)], "track_id long")
    got = {r["track_id"]: r["features"] for r in iv.track_features(frames, tracks, CFG).collect()}
    assert len(got[1]) == len(got[2]) == CFG.track_size == 668 and not any(got[2]) and sum(got[1][:24]) == pytest.approx(1)


def test_nulls_and_nans_are_unvoiced(spark):
    rows = [(1, 0, 0, None, True, 1.0), (1, 0, 1, math.nan, True, 1.0), (1, 0, 2, 220.0, None, 1.0), (1, 0, 3, 220.0, True, 1.0)]
    df = spark.createDataFrame(rows, "track_id long, seg_idx int, frame_idx long, f0_hz double, voiced_flag boolean, energy double")
    assert [r["v"] for r in iv.voiced_mask(df, CFG).orderBy("frame_idx").collect()] == [False, False, False, True]


def test_settings_are_checked():
    assert ModeConfig(bins=7).bins == 12 and ModeConfig(bins=36).bins == 36
    for make in (lambda: IntervalConfig(cadence=0), lambda: SplitConfig(val=0.6, test=0.5)):
        with pytest.raises(ValueError):
            make()


def test_tasks_follow_the_rows(spark):
    """A series is in one task, tasks grow in number and not in rows, and adaptive execution doesn't merge them."""
    for n in (400, 4000):
        df = spark.range(n).select((F.col("id") % (n // 4)).alias("track_id"), "id")
        placed = series.deal(df, "track_id", 50).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("track_id"))).withColumn("task", F.spark_partition_id())
        tasks = placed.groupBy("task").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).collect()
        assert sum(r["rows"] for r in tasks) == n and max(r["rows"] for r in tasks) < 150 and {r["n"] for r in tasks} == {4}
        assert placed.groupBy("track_id").agg(F.countDistinct("task").alias("t")).where("t > 1").count() == 0


def _tasks(df):
    rows = df.withColumn("_task", F.spark_partition_id()).collect()
    return {tuple(r)[:-1] for r in rows}, len({r["_task"] for r in rows})


def test_signal_tasks_follow_the_rows(spark, monkeypatch):
    """The v1 vector is the same however its series are dealt out, and more tasks make its rows."""
    from skein.plans import signal_queries as sq

    whole, _ = _tasks(sq.segment_vector_v1(spark, "/root/testdata/sf0.001"))
    series_ids = {r[0] for r in whole}
    monkeypatch.setattr(sq, "TASK_SERIES", 20)
    dealt, tasks = _tasks(sq.segment_vector_v1(spark, "/root/testdata/sf0.001"))
    assert dealt == whole and tasks >= len(series_ids) / 20 * 0.8 > 4
    assert min(_tasks(query(spark, "/root/testdata/sf0.001"))[1] for query in (sq.mfcc, sq.spectral_contrast, sq.tonnetz)) > 4


def test_frame_tasks_follow_the_rows(spark, monkeypatch):
    """Track vectors are the same however the tracks are dealt out, and no later exchange puts tracks together again."""
    from skein.plans import interval_queries as iq

    whole, _ = _tasks(iq.track_features(spark, "/root/testdata/sf0.001"))
    profiles, _ = _tasks(iq.interval_profile(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(series, "TASK_ROWS", 20)
    dealt, _ = _tasks(iq.track_features(spark, "/root/testdata/sf0.001"))
    again, tasks = _tasks(iq.interval_profile(spark, "/root/testdata/sf0.001"))
    assert dealt == whole and again == profiles
    assert tasks > 8  # 15 tracks over 50 tasks, where 4 shuffle partitions would hold them all


def test_prediction_tasks_follow_the_rows(spark, monkeypatch):
    """Predictions from frames are the same however the tracks are dealt out, and aren't put together in a few tasks."""
    from skein.plans import model_queries as mq

    whole, _ = _tasks(mq.predict_frames(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(series, "TASK_ROWS", 20)
    dealt, tasks = _tasks(mq.predict_frames(spark, "/root/testdata/sf0.001"))
    key = lambda r: r[:2]
    assert [r[:3] for r in sorted(dealt, key=key)] == [r[:3] for r in sorted(whole, key=key)]
    assert [r[3] for r in sorted(dealt, key=key)] == pytest.approx([r[3] for r in sorted(whole, key=key)], abs=2e-4)
    assert tasks > 8


def test_track_vectors_come_from_one_pass(spark, tmp_path):
    """All vectors of the frames' own tracks, those with nothing but zeros and frames without a track included, by one scan and no join; a
    join put further sorts and aggregates into each task, or sent all vectors to the driver."""
    from skein.operators.models import TrackFeatures

    data = [(t, i, 220.0 + 7 * (i % (t or 5)), t != 3, (i * 37 % 100) / 100, None if t == 3 else 4.0, None if t == 3 else 1.0) for t in (1, 2, 3, None) for i in range(65)] + [(4, 0, 220.0, True, 1.0, 4.0, 1.0)]
    made = spark.createDataFrame(data, "track_id long, frame_idx long, f0_hz double, voiced_flag boolean, energy double, h_power double, p_power double")
    made.write.parquet(str(tmp_path / "frames"))
    frames = spark.read.parquet(str(tmp_path / "frames"))
    own = TrackFeatures.by(CFG).transform(frames)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    got = {r["track_id"]: list(r["features"]) for r in own.collect()}
    asked = {r["track_id"]: r["features"] for r in iv.track_features(frames, frames.select("track_id").distinct(), CFG).collect()}
    assert got == asked and set(got) == {1, 2, 3, 4, None} and not any(got[3]) and not any(got[None]) and any(got[4])


def test_even_cuts_and_runs(spark):
    """Cuts in one pass are those at even_starts; runs are those of itertools, nulls and equal values apart included."""
    from itertools import groupby

    frames = spark.createDataFrame([(t, i, [1, 1, None, None, 2, 1, 2][(i * i + t) % 7]) for t, n in ((1, 67), (2, 20), (3, 5), (4, 21)) for i in range(n)], "track_id long, frame_idx long, x int")
    for segments in (1, 4):
        starts = series.even_starts(series.lengths(frames), 20, segments)
        key = lambda r: (r[0], r[3], r[1])
        got = series.cut_evenly(frames, 20, segments)
        assert sorted(got.collect(), key=key) == sorted(series.cut(frames, starts, 20).collect(), key=key)
    for track in (1, 2, 3, 4):
        rows = series.run_lengths(frames.where(f"track_id = {track}"), "x", ("track_id",)).orderBy("frame_idx").collect()
        assert [r["_length"] for r in rows] == [n for n in (len(list(g)) for _, g in groupby(r["x"] for r in rows)) for _ in range(n)]
