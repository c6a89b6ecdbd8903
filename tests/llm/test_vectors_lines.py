"""Hard negatives, line dedup and whitening against plain Python: nulls, empty and long values, ties, repeated rows, extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import hard_negatives, line_dedup, whitening

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "vec_id long, embedding array<float>, label int, row string, x double, a int, slot int"


def vectors(seed, n, width, spread=1.0, labels=3):
    rng = np.random.default_rng(seed)
    out = [(i, [float(v) for v in rng.normal(0, spread, width).astype(np.float32)], int(rng.integers(labels))) for i in range(n)]
    out += [(5, out[0][1], out[0][2]), (0, out[0][1], out[0][2]), (0, out[0][1], out[0][2])]  # repeated ids and rows
    out += [(None, out[3][1], 1), (900, None, 1), (901, [0.1, None, *[0.0] * (width - 2)], 1), (902, [math.nan] * width, 0), (903, [math.inf, *[0.0] * (width - 1)], 0), (904, out[1][1], None)]
    out += [(906, [0.5], 2), (910, [0.0] * width, 0), (920, [], 1)]
    return out


def whole(rows, width):
    return [(i, lab, [math.floor(256 * c) for c in v] + [0] * (width - len(v))) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def naive_negatives(rows, width, asks, k_pos=5, k_neg=10, low=(30, 100), high=(90, 100)):
    known = [(i, lab, x) for i, lab, x in whole(rows, width) if lab is not None]
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = Counter()
    for n, (i, lab, x) in enumerate(known):
        if i is None or not asks(i):
            continue
        scored = [(sum(p * q for p, q in zip(x, y, strict=True)), j, lj == lab) for m, (j, lj, y) in enumerate(known) if m != n]
        for p, j, _ in sorted((t for t in scored if t[2]), key=order)[:k_pos]:
            found = sorted((t for t in scored if not t[2] and low[0] * p <= low[1] * t[0] and high[1] * t[0] <= high[0] * p), key=order)[:k_neg]
            for rank, (s, other, _) in enumerate(found, 1):
                out[i, j, rank, other, p, s] += 1
    return out


def asdf(spark, rows):
    return spark.createDataFrame([(i, v, lab, "extra", 1.0, 2, 3) for i, v, lab in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("spread", "block_bytes", "low", "high"), [(1.0, 16_000_000, (30, 100), (90, 100)), (0.02, 600, (30, 100), (90, 100)), (0.3, 2000, (1, 2), (1, 1)), (0.3, 2000, (-9, 1), (2, 1))])
def test_hard_negatives(spark, spread, block_bytes, low, high):
    """Against all pairs; small spreads give many ties, small blocks give many blocks."""
    rows = vectors(int(spread * 100), 120, 4, spread)
    got = hard_negatives.mine(asdf(spark, rows), F.col("vec_id") % 5 == 0, block_bytes=block_bytes, low=low, high=high).collect()
    want = naive_negatives(rows, 4, lambda i: i % 5 == 0, low=low, high=high)
    assert len(want) > 50 and Counter(map(tuple, got)) == want


def test_hard_negatives_of_few_rows(spark):
    few = asdf(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, [0.4, 0.0], 2)])
    assert [tuple(r) for r in hard_negatives.mine(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 3, 65536, 26112)]
    assert hard_negatives.mine(few.where("vec_id > 0"), F.col("vec_id") == 0).count() == 0 and hard_negatives.mine(few.where("vec_id IN (0, 2)"), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mine(few.where("1 = 0"), F.lit(True)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    with pytest.raises(ValueError, match="exact"):
        hard_negatives.mine(asdf(spark, [(0, [1e9], 1), (1, [1e9], 1)]), F.lit(True))


def test_slots_send_at_most_k():
    """A combiner keeps k of each slot however many rows it sees, and all of the best."""
    block = hard_negatives.Anchors(np.array([1]), np.array([0]), np.array([[1]]))
    block.cut([[100, 80, 80, 60, -5]], (30, 100), (90, 100))
    assert block.upper.tolist() == [[90, 72, 54]] and block.floor.tolist() == [[72, 54, 17]]
    values = np.random.default_rng(1).permutation(np.repeat(np.arange(-20, 130), 40))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)) + 5), pa.array(np.arange(len(values))), pa.array(np.ones(len(values), np.int64)), pa.array([[v] for v in values.tolist()], pa.list_(pa.int64()))], names=list("rilx"))
    (sent,) = hard_negatives._top_slots(iter([batch]), block, 1, 10)
    assert sent.num_rows == 30 and set(sent["score"].to_pylist()) == {90, 72, 54}
    for slot, v in enumerate((90, 72, 54)):
        assert sorted(i for s, i in zip(sent["slot"].to_pylist(), sent["id"].to_pylist(), strict=True) if s == slot) == sorted(np.flatnonzero(values == v).tolist())[:10]


def line_key(line):
    return line.strip(" \t\n\x0b\f\r").translate(LOWER)


def naive_lines(rows, min_docs, min_chars):
    seen = Counter(k for _, t in rows for k in {line_key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < min_chars or seen[line_key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(4)
    common = ["Copyright 2020", "  COPYRIGHT 2020\t", "Über uns", "über uns", "ÀÉ ", "İstanbul ΣΑΣ", "x", "\x0bmenu\r", "MENU", "日本 Q", "a b", "ǅ Ⅷ", "", " "]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.5 else f"own {rng.randrange(40)}" for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n a", "menu", "\n".join(["menu"] * 50), "\n".join(f"line {i}" for i in range(3000)) + "\nMenu\n", "z" * 50_000 + "\r\nmenu", texts[0], texts[0]]
    return [(i % 50, t) for i, t in enumerate(texts)] + [(7, "menu\nsame row")] * 15 + [(None, "menu\nno id")] * 2


@pytest.mark.parametrize(("min_docs", "min_chars", "salts"), [(10, 1, 32), (3, 5, 2), (1, 0, 1), (10_000, 1, 4)])
def test_line_dedup(spark, lined, min_docs, min_chars, salts):
    df = spark.createDataFrame([(t, i, {"k": 1}, "y", 2, 3) for i, t in lined], "text string, doc_id long, _text map<string,int>, n_lines string, `_drop` int, `my col` int").repartition(4)
    want = naive_lines(lined, min_docs, min_chars)
    report = line_dedup.line_report(df.select("doc_id", "text", "_text"), min_docs=min_docs, min_chars=min_chars, salts=salts).collect()
    assert Counter(map(tuple, report)) == Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want)
    left = line_dedup.drop_lines(df, min_docs=min_docs, min_chars=min_chars, salts=salts)
    assert left.columns == [*df.columns, "n_lines", "n_dropped"]
    assert Counter((r[1], r[-2], r[-1], r[0]) for r in left.collect()) == Counter(want) and all(r[2] == {"k": 1} and r[3] == "y" for r in left.collect())
    assert line_dedup.line_report(df.where("1 = 0")).count() == 0


def test_lower_of_every_character(spark):
    """Only A-Z change, whatever else lower() would do."""
    points = [c for c in range(1, 0x1F000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"A{chr(c)}Z") for c in points], "c int, t string")
    wrong = [r["c"] for r in df.select("c", "t", line_dedup.lower_ascii(F.col("t")).alias("l")).collect() if r["l"] != r["t"].translate(LOWER)]
    assert not wrong


def test_line_dedup_is_native(spark, lined):
    df = spark.createDataFrame([(i, t) for i, t in lined], "doc_id long, text string")
    plan = line_dedup.line_report(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapInArrow", plan.replace("LogicalRDD", "").replace("Scan ExistingRDD", ""))


def naive_whitening(rows, width, k):
    x = np.array(sorted({tuple(v) for _, _, v in whole(rows, width)}), dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    a = (n * x - sums) / n
    values, parts = np.linalg.eigh(a.T @ a / n)
    return n, sums, values[::-1][:k], parts[:, ::-1][:, :k].T, values.sum()


@pytest.mark.parametrize(("seed", "width", "spread"), [(1, 6, 1.0), (2, 3, 40.0), (3, 5, 0.01)])
def test_whitening(spark, seed, width, spread):
    rows = vectors(seed, 300, width, spread)
    k = min(4, width)
    n, sums, values, parts, total = naive_whitening(rows, width, k)
    got = whitening.whiten(asdf(spark, rows)).collect()
    good = whole(rows, width)
    assert len(got) == len(good) * k and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    assert all(r["explained"] == pytest.approx(values[r["component"] - 1] / total, rel=1e-9) and r["identity_error"] < 1e-9 for r in got)
    for c in range(k):
        mine = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["whitened"]) for r in got if r["component"] == c + 1)
        want = [(i is None, i or 0, int(sum((n * a - s) ** 2 for a, s in zip(x, sums.tolist(), strict=True))), float((np.array(x) - sums / n) @ parts[c] / math.sqrt(values[c]))) for i, _, x in good]
        sign = 1 if np.corrcoef([m[3] for m in mine], [w[3] for w in sorted(want)])[0, 1] > 0 else -1
        want = sorted((a, b, d, sign * w) for a, b, d, w in want)
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        assert [m[3] for m in mine] == pytest.approx([w[3] for w in want], abs=1e-8)


def test_whitening_without_variance(spark):
    """A constant place, a place that repeats another, one vector, none."""
    rng = np.random.default_rng(7)
    rows = [(i, [v, 0.25, v, w], 0) for i, (v, w) in enumerate(zip((rng.integers(-50, 50, 80) / 8).tolist(), rng.integers(-9, 9, 80).astype(float).tolist(), strict=True))]
    got = whitening.whiten(asdf(spark, rows)).collect()
    assert {r["component"] for r in got if r["whitened"] is None} == {3, 4} and {r["explained"] for r in got if r["component"] > 2} == {0.0}
    assert all(r["identity_error"] < 1e-8 for r in got) and sum({r["explained"] for r in got}) == pytest.approx(1)
    one = whitening.whiten(asdf(spark, [(1, [1.0, 2.0], 0)] * 3)).collect()
    assert len(one) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["identity_error"] is None for r in one)
    assert whitening.whiten(asdf(spark, rows).where("1 = 0")).count() == 0 and whitening.whiten(asdf(spark, [(1, None, 0), (2, [], 0)])).count() == 0


def test_whitening_keeps_small_components(spark):
    """Variances that span twelve orders of magnitude: a covariance in doubles would lose the last, R doesn't."""
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    x = np.floor(rng.normal(size=(500, 3)) * [3e7, 3e4, 30] @ turn)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v) for i, v, _ in rows], "vec_id long, embedding array<double>").repartition(4)
    fit = whitening.fit(df.select(F.transform("embedding", lambda c: c.cast("long")).alias("x")).distinct().cache())
    a = x - x.mean(axis=0)
    singular = np.linalg.svd(a, compute_uv=False)
    assert fit.variances == pytest.approx(singular**2 / len(x), rel=1e-6) and fit.error < 1e-4


def test_deviation_beyond_a_long():
    m = whitening.Whitening(2**31, 1, 2**20, np.array([0]), np.zeros((0, 1)), np.zeros(0), 0.0)
    assert m.deviations(np.array([[1], [2**20]])) == [2**62, None]
