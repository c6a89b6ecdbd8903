"""The one-pass profile against the operators that give each feature alone, under settings other than the default."""

import random
from collections import defaultdict
from dataclasses import replace

import pytest

from skein.config import IntervalConfig
from skein.operators import intervals as iv

G = ("track_id", "seg_idx")


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(5)
    rows = []
    for track in range(6):
        pitch = 220.0
        for seg in range(2):
            for i in range(rng.choice([1, 8, 60])):
                pitch = pitch if rng.random() < 0.5 else 110 * 2 ** (rng.randint(0, 36) / 24)
                rows.append((track, seg, i, pitch if rng.random() < 0.95 else None, rng.random() < 0.97, rng.random(), 1.0, rng.choice([0.1, 0.5])))
    return spark.createDataFrame(rows, "track_id long, seg_idx int, frame_idx long, f0_hz double, voiced_flag boolean, energy double, h_power double, p_power double").cache()


@pytest.mark.parametrize("duration_bins", [8, 12, 6, 3])
def test_profile_matches_its_parts(frames, duration_bins):
    cfg = replace(IntervalConfig(), duration_bins=duration_bins, min_run=1, min_harmonic_ratio=0.1, step_clip=5)
    held = iv.voiced_frames(frames, cfg)
    itv = iv.intervals(iv.notes(held, cfg), cfg)
    buckets = iv.durations(itv) if duration_bins == 8 else iv.duration_quantiles(itv, duration_bins)
    want = {}
    for name, rows, place in (
        ("hist", iv.histogram(itv, "itv"), lambda r: r["itv"]), ("trans", iv.transitions(itv), lambda r: r["previous"] * cfg.bins + r["itv"]), ("cadence", iv.cadences(itv), lambda r: r["itv"]),
        ("step", iv.steps(itv), lambda r: r["step"] + cfg.step_clip), ("duration", buckets, lambda r: r["bucket"]),
    ):
        want |= {(r["track_id"], r["seg_idx"], name, place(r)): r["value"] for r in rows.collect()}
    rows = iv.profile(held, cfg).collect()
    got = {(*[r[c] for c in G], r["feature"], r["idx"]): r["value"] for r in rows}
    assert len(got) == len(rows) and {k for k in got if k[2] != "scalar"} == set(want) and len(want) > 100
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    assert max(k[3] for k in got if k[2] == "duration") < duration_bins
    gate = {tuple(r[c] for c in G): r for r in iv.gate(held, cfg).collect()}
    strength = {tuple(r[c] for c in G): r["tonic_strength"] for r in iv.tonics(iv.notes(held, cfg)).collect()}
    for key, r in gate.items():
        scalars = [got[(*key, "scalar", i)] for i in range(8)]
        assert scalars[0] == pytest.approx(r["voiced_ratio"]) and scalars[1] == pytest.approx(r["harmonic_ratio"]) and scalars[7] == float(r["pitched"])
        assert scalars[2] == pytest.approx(strength.get(key, 0.0))
    vectors = iv.dense(iv.profile(held, cfg), cfg.segment_size, iv.place(cfg), list(G)).collect()
    by_segment = defaultdict(dict)
    for (t, seg, name, idx), value in got.items():
        by_segment[t, seg][iv.offsets(cfg)[name] + idx] = value
    assert {(r["track_id"], r["seg_idx"]) for r in vectors} == set(gate)
    for r in vectors:
        assert r["features"] == pytest.approx([by_segment[r["track_id"], r["seg_idx"]].get(i, 0.0) for i in range(cfg.segment_size)])


def test_profile_reads_its_source_once(frames):
    plan = iv.profile(iv.voiced_frames(frames, IntervalConfig()), IntervalConfig())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and "Join" not in plan
    assert iv.profile(frames.selectExpr("*", "voiced_flag AS voiced").where("1 = 0"), IntervalConfig()).count() == 0
