"""Queries of signals and training items, with their SQL. An embedding is a signal of 64 samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.scalars import num
from ..operators import manifest, prep, series
from ..operators import signals as sg
from ..sources.shared import materialize
from .adapters import FRAMES_SQL, frames, table

RATE, FFT, HOP, HALF = 22050, 16, 4, 2
KEYS = sg.KEYS
#: Signals of a task; a signal becomes 117 rows of its spectrum.
TASK_SERIES = 1_000


def _signals(spark: SparkSession, d: str) -> DataFrame:
    samples = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("series_id"), F.lit(RATE).alias("sample_rate"), samples.alias("samples"), "label")


def _frames(spark, d):
    return sg.frame_signal(_signals(spark, d), FFT, HOP)


def _dealt(spark, d, rows):
    """What is made of the signals, TASK_SERIES of them a task."""
    return series.deal(rows, "series_id", TASK_SERIES, _signals(spark, d))


def _spectrum(spark, d):
    return _dealt(spark, d, sg.power_spectrum(_frames(spark, d), FFT))


def r6(c, out=None):
    return F.round(c, 6).alias(out or c)


def frame_signal(spark, d):
    return _frames(spark, d).select(*KEYS, F.posexplode("frame").alias("place", "value")).select(*KEYS, "place", r6("value"))


def frame_rms(spark, d):
    return sg.frame_rms(_frames(spark, d)).select(*KEYS, r6("rms"))


def trim_silence(spark, d):
    return sg.trim_silence(sg.frame_rms(_frames(spark, d)), 3.0).select(*KEYS, r6("rms"))


def power_spectrum(spark, d):
    return _spectrum(spark, d).select(*KEYS, "bin", r6("value"))


def hpss_ratio(spark, d):
    return sg.harmonic_share(sg.hpss(_spectrum(spark, d), HALF)).select("series_id", F.round("harmonic_ratio", 5).alias("harmonic_ratio"))


def _weights() -> np.ndarray:
    return np.fromfunction(lambda o, i: ((o * 7 + i * 3) % 5) / 4, (6, 64))


def linear_map(spark, d):
    rows = _signals(spark, d).select("series_id", F.posexplode("samples").alias("place", "x"))
    return sg.linear_map(rows, ["series_id"], "place", "x", _weights()).select("series_id", "o", r6("value"))


def chroma(spark, d):
    return sg.chroma(_spectrum(spark, d), RATE, FFT).select(*KEYS, "o", r6("value"))


def spectral_contrast(spark, d):
    return sg.contrast(_spectrum(spark, d), [2, 4], 0.3).select(*KEYS, "band", F.round("contrast", 4).alias("contrast"))


def power_db(spark, d):
    rows = _signals(spark, d).select("series_id", F.posexplode("samples").alias("place", "x")).withColumn("p", F.col("x") * F.col("x"))
    return sg.power_db(rows, "p", ["series_id"], 40.0).select("series_id", "place", r6("db"))


def zscore_segment(spark, d):
    return _signals(spark, d).select("series_id", F.posexplode(sc.z_score(F.col("samples"))).alias("place", "z")).select("series_id", "place", r6("z"))


def moving_median(spark, d):
    return series.moving_median(frames(spark, d).select("track_id", "frame_idx", "f0_hz"), "f0_hz", "m", 3, ["track_id"], "frame_idx").select("track_id", "frame_idx", r6("m"))


def delta_features(spark, d):
    return sg.delta(frames(spark, d), "f0_hz", ["track_id"], 4).where("delta IS NOT NULL").select("track_id", "frame_idx", r6("delta"))


def summary_stats(spark, d):
    rows = _signals(spark, d).select("label", F.posexplode("samples").alias("coef", "x"))
    return sg.summary(rows, "x", ["label", "coef"]).select("label", "coef", r6("mean"), r6("std"))


def mel_db(spark, d):
    return sg.mel_db(_spectrum(spark, d), RATE, FFT, 8).select(*KEYS, "o", F.round("db", 4).alias("db"))


def mfcc(spark, d):
    return sg.mfcc(sg.mel_db(_spectrum(spark, d), RATE, FFT, 8), 8, 5).select(*KEYS, "o", F.round("value", 4).alias("value"))


def tonnetz(spark, d):
    parts = _dealt(spark, d, sg.hpss(_spectrum(spark, d), HALF).select(*KEYS, "bin", F.col("harmonic").alias("value")))
    return sg.tonnetz(sg.chroma(parts, RATE, FFT)).select(*KEYS, "o", F.round("value", 5).alias("value"))


def segment_vector_v1(spark, d):
    """Six blocks of one spectrum, which is written once together with its harmonic part and dealt out by series again."""
    both = _dealt(spark, d, materialize(sg.hpss(_spectrum(spark, d), HALF).select(*KEYS, "bin", "value", "harmonic"), "spectrum"))
    spectrum, parts = both.drop("harmonic"), both.select(*KEYS, "bin", F.col("harmonic").alias("value"))
    return sg.segment_vector(spectrum, parts, RATE, FFT, [2, 4], 0.3, 8, 5).select("series_id", "feature", "idx", r6("value"))


def yin_f0(spark, d):
    whole = _signals(spark, d).select("series_id", F.lit(0).alias("frame_idx"), "sample_rate", F.col("samples").alias("frame"))
    return sg.yin(whole, RATE / 24, RATE / 3).select(*KEYS, r6("f0_hz"), "voiced_flag")


def _items(spark, d):
    base = _signals(spark, d)
    path = F.col("series_id").cast("string")
    split = F.when(F.pmod("series_id", F.lit(5)) == 0, "test").otherwise("train")
    return prep.items(base.withColumn("split", split), 3, 1).withColumn("start", prep.crop_start(F.size("samples"), 48, path, F.col("seg_idx"), F.col("split") == "train"))


def crop_plan(spark, d):
    rows = _items(spark, d).withColumn("crop", prep.crop(F.col("samples"), F.col("start"), 48))
    return rows.select("series_id", "split", "seg_idx", "start", F.round(sc.total(F.col("crop")), 6).alias("total"))


def pad_truncate(spark, d):
    size = F.when(F.pmod("series_id", F.lit(2)) == 0, 70).otherwise(40)
    rows = _signals(spark, d).select("series_id", F.posexplode(prep.pad_or_cut(F.col("samples"), size)).alias("place", "x"))
    return rows.select("series_id", "place", r6("x"))


def block_mask(spark, d):
    masked = prep.block_mask(F.col("samples"), 16, F.col("series_id").cast("string"))
    return _signals(spark, d).select("series_id", F.posexplode(masked).alias("place", "x")).select("series_id", "place", r6("x"))


def _matrices(spark, d):
    """An embedding as 8 bins of 8 frames."""
    matrix = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.slice("samples", b * 8 + 1, F.lit(8)))
    return _signals(spark, d).select("series_id", "samples", F.col("series_id").cast("string").alias("path"), matrix.alias("matrix"))


def _cells(rows):
    """series_id, bin, frame_idx, x of all cells of matrix."""
    by_bin = rows.select("series_id", F.posexplode("matrix").alias("bin", "_row"))
    return by_bin.select("series_id", "bin", F.posexplode("_row").alias("frame_idx", "x")).select("series_id", "bin", "frame_idx", r6("x"))


def matrix_scaled(spark, d):
    return _cells(_matrices(spark, d).withColumn("matrix", prep.scale_matrix(F.col("matrix"))))


def matrix_crop(spark, d):
    """Five frames from a drawn place for training (odd ids), from the middle otherwise."""
    rows = _matrices(spark, d).withColumn("start", prep.crop_start(prep.frames_of(F.col("matrix")), 5, F.col("path"), F.lit(0), F.col("series_id") % 2 == 1))
    return _cells(rows.withColumn("matrix", prep.crop_frames(F.col("matrix"), F.col("start"), 5)))


def matrix_mask_frames(spark, d):
    return _cells(_matrices(spark, d).withColumn("matrix", prep.mask_frames(F.col("matrix"), 4, F.col("path"))))


def matrix_mask_bins(spark, d):
    return _cells(_matrices(spark, d).withColumn("matrix", prep.mask_bins(F.col("matrix"), 4, F.col("path"))))


def matrix_attach_rows(spark, d):
    """Below the bins, a row for each of the first three samples of the series."""
    return _cells(_matrices(spark, d).withColumn("matrix", prep.attach_rows(F.col("matrix"), F.slice("samples", 1, 3))))


def balanced_sample(spark, d):
    return prep.balanced_sample(_signals(spark, d), "series_id")


def design_matrix(spark, d):
    """Segments' vectors with the label of their track and a vector of the track beside them; four embeddings are a track."""
    base = _signals(spark, d)
    first = base.where("series_id % 4 = 0")  # a track's own row
    tracks = first.select((F.col("series_id") / 4).cast("long").alias("track_id"), F.col("label").cast("string").alias("name"), F.slice("samples", 1, 2).alias("own"))
    segments = base.select(F.floor(F.col("series_id") / 4).alias("track_id"), (F.col("series_id") % 4).cast("int").alias("seg_idx"), F.slice("samples", 1, 4).alias("vec"))
    joined = prep.attach_tracks(segments, tracks, "vec", "own", F.col("name"), [str(i) for i in range(10)])
    rows = joined.select("track_id", "seg_idx", "label_idx", F.posexplode("features").alias("idx", "value"))
    return rows.select("track_id", "seg_idx", "label_idx", "idx", r6("value"))


_FLAT = "WITH flat AS (SELECT vec_id AS series_id, label, CAST(i AS INTEGER) AS place, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i))"
_FR = _FLAT + ", fr AS (SELECT series_id, CAST(k AS INTEGER) AS frame_idx, CAST(place - 4 * k AS INTEGER) AS place, x FROM flat, range(13) r(k) WHERE place >= 4 * k AND place < 4 * k + 16)"
_RMS = _FR + ", rms AS (SELECT series_id, frame_idx, sqrt(avg(x * x)) + 1e-12 AS rms FROM fr GROUP BY 1, 2)"
_SPEC = _FR + """, w AS (SELECT series_id, frame_idx, place, x * (CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos(2 * pi() * place / 16)) AS x FROM fr),
 spec AS (SELECT series_id, frame_idx, CAST(b AS INTEGER) AS bin, power(sum(x * cos(2 * pi() * b * place / 16)), 2) + power(sum(x * sin(2 * pi() * b * place / 16)), 2) AS value FROM w, range(9) r(b) GROUP BY 1, 2, 3)"""
_MEL = _SPEC + """, t AS (SELECT 3e-1 AS low, 15 + 27 * ln(8e0) / ln(64e-1) AS high),
 m AS (SELECT e, low + e * (high - low) / 9 AS mel FROM t, range(10) r(e)),
 h AS (SELECT e, CASE WHEN mel < 15 THEN mel * 200 / 3 ELSE 1000 * exp((mel - 15) * ln(64e-1) / 27) END AS hz FROM m),
 b AS (SELECT x.e AS o, x.hz AS a, y.hz AS b, z.hz AS c FROM h x JOIN h y ON y.e = x.e + 1 JOIN h z ON z.e = x.e + 2),
 w8 AS (SELECT CAST(o AS INTEGER) AS o, bin, least((f - a) / (b - a), (c - f) / (c - b)) * 2 / (c - a) AS weight FROM b, (SELECT i AS bin, i * 22050 / 16e0 AS f FROM range(9) r(i))),
 mel AS (SELECT series_id, frame_idx, o, sum(weight * value) AS v FROM spec JOIN w8 USING (bin) WHERE weight > 0 GROUP BY 1, 2, 3),
 db AS (SELECT series_id, frame_idx, o, greatest(10 * log10(greatest(v, 1e-10)) - 10 * log10(greatest(max(v) OVER (PARTITION BY series_id), 1e-10)), -80) AS db FROM mel)"""
_CELLS = _FLAT + ", cells AS (SELECT series_id, CAST(place // 8 AS INTEGER) AS bin, CAST(place % 8 AS INTEGER) AS frame_idx, x FROM flat)"
_DRAW = lambda text, n: f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % ({n}))"

ORACLES = {
    "frame_signal": _FR + " SELECT series_id, frame_idx, place, round(x, 6) AS value FROM fr",
    "frame_rms": _RMS + " SELECT series_id, frame_idx, round(rms, 6) AS rms FROM rms",
    "trim_silence": _RMS + """, l AS (SELECT *, 20 * log10(rms / max(rms) OVER (PARTITION BY series_id)) >= -3 AS loud FROM rms),
        e AS (SELECT *, min(CASE WHEN loud THEN frame_idx END) OVER (PARTITION BY series_id) AS a, max(CASE WHEN loud THEN frame_idx END) OVER (PARTITION BY series_id) AS b FROM l)
        SELECT series_id, frame_idx, round(rms, 6) AS rms FROM e WHERE frame_idx BETWEEN a AND b""",
    "power_spectrum": _SPEC + " SELECT series_id, frame_idx, bin, round(value, 6) AS value FROM spec",
    "hpss_ratio": _SPEC + """, m AS (SELECT *, median(value) OVER (PARTITION BY series_id, bin ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h, median(value) OVER (PARTITION BY series_id, frame_idx ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS p FROM spec),
        k AS (SELECT *, CASE WHEN h * h + p * p > 0 THEN h * h / (h * h + p * p) ELSE 0.5 END AS mask FROM m),
        g AS (SELECT series_id, sqrt(avg(value * mask)) + 1e-12 AS h, sqrt(avg(value * (1 - mask))) + 1e-12 AS p FROM k GROUP BY 1)
        SELECT series_id, round(h / (h + p + 1e-9), 5) AS harmonic_ratio FROM g""",
    "linear_map": _FLAT + " SELECT series_id, CAST(o AS INTEGER) AS o, round(sum(x * ((o * 7 + place * 3) % 5) / 4), 6) AS value FROM flat, range(6) r(o) WHERE (o * 7 + place * 3) % 5 <> 0 GROUP BY 1, 2",
    "chroma": _SPEC + """, c AS (SELECT series_id, frame_idx, CAST(((floor(12 * log2(bin * 22050 / CAST(16 AS DOUBLE) / 440) + 69 + 0.5) % 12) + 12) % 12 AS INTEGER) AS o, sum(value) AS v FROM spec WHERE bin > 0 GROUP BY 1, 2, 3)
        SELECT series_id, frame_idx, o, round(CASE WHEN max(v) OVER (PARTITION BY series_id, frame_idx) > 0 THEN v / max(v) OVER (PARTITION BY series_id, frame_idx) ELSE 0 END, 6) AS value FROM c""",
    "spectral_contrast": _SPEC + """, b AS (SELECT *, CASE WHEN bin >= 4 THEN 2 WHEN bin >= 2 THEN 1 ELSE 0 END AS band FROM spec),
        r AS (SELECT *, row_number() OVER (PARTITION BY series_id, frame_idx, band ORDER BY value, bin) AS r, count(*) OVER (PARTITION BY series_id, frame_idx, band) AS n FROM b),
        k AS (SELECT *, greatest(1, floor(n * CAST(0.3 AS DOUBLE) + 0.5)) AS k FROM r),
        m AS (SELECT series_id, frame_idx, band, avg(value) FILTER (r <= k) AS lo, avg(value) FILTER (r > n - k) AS hi FROM k GROUP BY 1, 2, 3)
        SELECT series_id, frame_idx, band, round(10 * log10(greatest(hi, 1e-10)) - 10 * log10(greatest(lo, 1e-10)), 4) AS contrast FROM m""",
    "mel_db": _MEL + " SELECT series_id, frame_idx, o, round(db, 4) AS db FROM db",
    "mfcc": _MEL + " SELECT series_id, frame_idx, CAST(k AS INTEGER) AS o, round(sum(db * cos(pi() * k * (o + 5e-1) / 8) * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / 8e0)), 4) AS value FROM db, range(5) r(k) GROUP BY 1, 2, 3",
    "tonnetz": _SPEC + """, m AS (SELECT *, median(value) OVER (PARTITION BY series_id, bin ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h, median(value) OVER (PARTITION BY series_id, frame_idx ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS p FROM spec),
        k AS (SELECT series_id, frame_idx, bin, value * CASE WHEN h * h + p * p > 0 THEN h * h / (h * h + p * p) ELSE 0.5 END AS value FROM m),
        c AS (SELECT series_id, frame_idx, ((floor(12 * log2(bin * 22050 / CAST(16 AS DOUBLE) / 440) + 69 + 0.5) % 12) + 12) % 12 AS c, sum(value) AS v FROM k WHERE bin > 0 GROUP BY 1, 2, 3),
        s AS (SELECT *, CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 0 END AS share FROM c WINDOW w AS (PARTITION BY series_id, frame_idx))
        SELECT series_id, frame_idx, CAST(o AS INTEGER) AS o, round(sum(share * CASE WHEN o > 3 THEN 5e-1 ELSE 1 END
               * CASE WHEN o % 2 = 0 THEN sin(pi() * [7e0 / 6, 15e-1, 2e0 / 3][o // 2 + 1] * c) ELSE cos(pi() * [7e0 / 6, 15e-1, 2e0 / 3][o // 2 + 1] * c) END), 5) AS value FROM s, range(6) r(o) GROUP BY 1, 2, 3""",
    # Means and deviations of six blocks; a slope at the ends is that of the nearest frame with all its neighbours.
    "segment_vector_v1": _MEL + """, ceps AS (SELECT series_id, frame_idx, k AS o, sum(db * cos(pi() * k * (o + 5e-1) / 8) * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / 8e0)) AS v FROM db, range(5) r(k) GROUP BY 1, 2, 3),
        inner_ AS (SELECT series_id, frame_idx, o, ((lead(v, 1) OVER win - lag(v, 1) OVER win) + 2 * (lead(v, 2) OVER win - lag(v, 2) OVER win) + 3 * (lead(v, 3) OVER win - lag(v, 3) OVER win)
                   + 4 * (lead(v, 4) OVER win - lag(v, 4) OVER win)) / 60 AS d FROM ceps WINDOW win AS (PARTITION BY series_id, o ORDER BY frame_idx)),
        slopes AS (SELECT series_id, o, coalesce(d, last_value(d IGNORE NULLS) OVER (PARTITION BY series_id, o ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   first_value(d IGNORE NULLS) OVER (PARTITION BY series_id, o ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM inner_),
        notes AS (SELECT *, ((floor(12 * log2(bin * 22050 / CAST(16 AS DOUBLE) / 440) + 69 + 0.5) % 12) + 12) % 12 AS note FROM spec WHERE bin > 0),
        chr AS (SELECT series_id, frame_idx, note, sum(value) AS v FROM notes GROUP BY 1, 2, 3),
        chrs AS (SELECT series_id, note, CASE WHEN max(v) OVER win > 0 THEN v / max(v) OVER win ELSE 0 END AS v FROM chr WINDOW win AS (PARTITION BY series_id, frame_idx)),
        bands AS (SELECT *, CASE WHEN bin >= 4 THEN 2 WHEN bin >= 2 THEN 1 ELSE 0 END AS band FROM spec),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, frame_idx, band ORDER BY value, bin) AS place, count(*) OVER (PARTITION BY series_id, frame_idx, band) AS n FROM bands),
        ends AS (SELECT series_id, frame_idx, band, avg(value) FILTER (place <= greatest(1, floor(n * CAST(0.3 AS DOUBLE) + 0.5))) AS lo, avg(value) FILTER (place > n - greatest(1, floor(n * CAST(0.3 AS DOUBLE) + 0.5))) AS hi FROM ranked GROUP BY 1, 2, 3),
        notes0 AS (SELECT *, CASE WHEN bin > 0 THEN ((floor(12 * log2(greatest(bin, 1) * 22050 / CAST(16 AS DOUBLE) / 440) + 69 + 0.5) % 12) + 12) % 12 END AS note FROM spec),
        med AS (SELECT *, median(value) OVER (PARTITION BY series_id, bin ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hm, median(value) OVER (PARTITION BY series_id, frame_idx ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS pm FROM notes0),
        har AS (SELECT series_id, frame_idx, note, sum(value * CASE WHEN hm * hm + pm * pm > 0 THEN hm * hm / (hm * hm + pm * pm) ELSE 0.5 END) AS v FROM med WHERE bin > 0 GROUP BY 1, 2, 3),
        shares AS (SELECT *, CASE WHEN sum(v) OVER win > 0 THEN v / sum(v) OVER win ELSE 0 END AS share FROM har WINDOW win AS (PARTITION BY series_id, frame_idx)),
        circles AS (SELECT series_id, frame_idx, o, sum(share * CASE WHEN o > 3 THEN 5e-1 ELSE 1 END
                    * CASE WHEN o % 2 = 0 THEN sin(pi() * [7e0 / 6, 15e-1, 2e0 / 3][o // 2 + 1] * note) ELSE cos(pi() * [7e0 / 6, 15e-1, 2e0 / 3][o // 2 + 1] * note) END) AS v FROM shares, range(6) r(o) GROUP BY 1, 2, 3),
        every AS (SELECT series_id, 'mel' AS feature, o, 8 AS width, db AS x FROM db UNION ALL SELECT series_id, 'mfcc', o, 5, v FROM ceps UNION ALL SELECT series_id, 'delta', o, 5, v FROM slopes
                  UNION ALL SELECT series_id, 'chroma', note, 12, v FROM chrs UNION ALL SELECT series_id, 'contrast', band, 3, 10 * log10(greatest(hi, 1e-10)) - 10 * log10(greatest(lo, 1e-10)) FROM ends
                  UNION ALL SELECT series_id, 'tonnetz', o, 6, v FROM circles),
        stats AS (SELECT series_id, feature, o, width, avg(x) AS mean, stddev_pop(x) AS std FROM every GROUP BY 1, 2, 3, 4)
        SELECT series_id, feature, CAST(o AS INTEGER) AS idx, round(mean, 6) AS value FROM stats UNION ALL SELECT series_id, feature, CAST(o + width AS INTEGER), round(std, 6) FROM stats""",
    "yin_f0": _FLAT + """, d AS (SELECT a.series_id, b.place - a.place AS lag, sum((a.x - b.x) * (a.x - b.x)) AS d FROM flat a JOIN flat b ON a.series_id = b.series_id AND b.place - a.place BETWEEN 1 AND 24 WHERE a.place < 40 GROUP BY 1, 2),
        r AS (SELECT *, sum(d) OVER (PARTITION BY series_id ORDER BY lag) AS run FROM d),
        n AS (SELECT series_id, lag, CASE WHEN run > 0 THEN d * lag / run ELSE 1 END AS norm FROM r),
        l AS (SELECT *, lead(norm) OVER (PARTITION BY series_id ORDER BY lag) AS after, min(CASE WHEN lag >= 3 AND norm < 1e-1 THEN lag END) OVER (PARTITION BY series_id) AS first FROM n)
        SELECT series_id, 0 AS frame_idx, round(22050 / CAST(coalesce(min(CASE WHEN lag >= first AND (after IS NULL OR after >= norm) THEN lag END), arg_min(lag, norm) FILTER (lag >= 3)) AS DOUBLE), 6) AS f0_hz, bool_or(first IS NOT NULL) AS voiced_flag FROM l GROUP BY 1""",
    "power_db": _FLAT + " SELECT series_id, place, round(greatest(10 * log10(greatest(x * x, 1e-10)) - 10 * log10(greatest(max(x * x) OVER (PARTITION BY series_id), 1e-10)), -40), 6) AS db FROM flat",
    "zscore_segment": _FLAT + " SELECT series_id, place, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-6), 6) AS z FROM flat WINDOW w AS (PARTITION BY series_id)",
    "moving_median": "WITH " + FRAMES_SQL.strip() + " SELECT track_id, frame_idx, round(median(f0_hz) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS m FROM frames",
    "delta_features": "WITH " + FRAMES_SQL.strip() + """, s AS (SELECT track_id, frame_idx, (1 * (lead(f0_hz, 1) OVER w - lag(f0_hz, 1) OVER w) + 2 * (lead(f0_hz, 2) OVER w - lag(f0_hz, 2) OVER w) + 3 * (lead(f0_hz, 3) OVER w - lag(f0_hz, 3) OVER w) + 4 * (lead(f0_hz, 4) OVER w - lag(f0_hz, 4) OVER w)) / 60 AS delta
        FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)) SELECT track_id, frame_idx, round(delta, 6) AS delta FROM s WHERE delta IS NOT NULL""",
    "summary_stats": _FLAT + " SELECT label, place AS coef, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM flat GROUP BY 1, 2",
    "crop_plan": _FLAT + f""", t AS (SELECT vec_id AS series_id, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM embeddings),
        i AS (SELECT series_id, split, CAST(k AS INTEGER) AS seg_idx, CASE WHEN split = 'train' THEN {_DRAW("series_id || '|42|' || k", "17")} ELSE 8 END AS start FROM t, range(3) r(k) WHERE split = 'train' OR k = 0)
        SELECT i.series_id, split, seg_idx, start, round(sum(x), 6) AS total FROM i JOIN flat f ON f.series_id = i.series_id AND place >= start AND place < start + 48 GROUP BY 1, 2, 3, 4""",
    "pad_truncate": _FLAT + """ SELECT s.vec_id AS series_id, CAST(k AS INTEGER) AS place, round(coalesce(x, 0), 6) AS x FROM embeddings s, range(70) r(k) LEFT JOIN flat f ON f.series_id = s.vec_id AND f.place = k
        WHERE k < CASE WHEN s.vec_id % 2 = 0 THEN 70 ELSE 40 END""",
    "block_mask": _FLAT + f""", w AS (SELECT *, {_DRAW("series_id || '|42|width'", "17")} AS width FROM flat), s AS (SELECT *, {_DRAW("series_id || '|42|start'", "65 - width")} AS start FROM w)
        SELECT series_id, place, round(CASE WHEN place >= start AND place < start + width THEN 0 ELSE x END, 6) AS x FROM s""",
    "matrix_scaled": _CELLS + """ SELECT series_id, bin, frame_idx, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-6), 6) AS x FROM cells WINDOW w AS (PARTITION BY series_id)""",
    "matrix_crop": _CELLS + f""", s AS (SELECT *, CASE WHEN series_id % 2 = 1 THEN {_DRAW("series_id || '|42|0'", "4")} ELSE 1 END AS start FROM cells)
        SELECT series_id, bin, CAST(frame_idx - start AS INTEGER) AS frame_idx, round(x, 6) AS x FROM s WHERE frame_idx >= start AND frame_idx < start + 5""",
    "matrix_mask_frames": _CELLS + f""", w AS (SELECT *, {_DRAW("series_id || '|42|frames|width'", "5")} AS width FROM cells), s AS (SELECT *, {_DRAW("series_id || '|42|frames|start'", "9 - width")} AS start FROM w)
        SELECT series_id, bin, frame_idx, round(CASE WHEN frame_idx >= start AND frame_idx < start + width THEN 0 ELSE x END, 6) AS x FROM s""",
    "matrix_mask_bins": _CELLS + f""", w AS (SELECT *, {_DRAW("series_id || '|42|bins|width'", "5")} AS width FROM cells), s AS (SELECT *, {_DRAW("series_id || '|42|bins|start'", "9 - width")} AS start FROM w)
        SELECT series_id, bin, frame_idx, round(CASE WHEN bin >= start AND bin < start + width THEN 0 ELSE x END, 6) AS x FROM s""",
    "matrix_attach_rows": _CELLS + """ SELECT series_id, bin, frame_idx, round(x, 6) AS x FROM cells
        UNION ALL SELECT series_id, CAST(8 + place AS INTEGER), CAST(k AS INTEGER), round(x, 6) FROM flat, range(8) r(k) WHERE place < 3""",
    "balanced_sample": f"""WITH ranked AS (SELECT vec_id AS series_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS r FROM embeddings),
        sizes AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS c FROM embeddings GROUP BY 1),
        d AS (SELECT i AS draw, {_DRAW("i || '|42|class'", "(SELECT count(*) FROM sizes)")} AS c FROM range((SELECT count(*) FROM embeddings)) t(i)),
        p AS (SELECT draw, label, {_DRAW("draw || '|42|row'", "n")} + 1 AS r FROM d JOIN sizes USING (c))
        SELECT draw, label, series_id FROM p JOIN ranked USING (label, r)""",
    "design_matrix": """WITH v AS (SELECT vec_id // 4 AS track_id, CAST(vec_id % 4 AS INTEGER) AS seg_idx, embedding FROM embeddings), t AS (SELECT vec_id // 4 AS track_id, label, embedding AS own FROM embeddings WHERE vec_id % 4 = 0)
        SELECT track_id, seg_idx, label AS label_idx, CAST(i AS INTEGER) AS idx, round(CAST(CASE WHEN i < 4 THEN embedding[i + 1] ELSE own[i - 3] END AS DOUBLE), 6) AS value FROM v JOIN t USING (track_id), range(6) r(i)""",
}

ROWS_ONLY = ()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in (*ORACLES, *ROWS_ONLY)}


def oracle_sql() -> dict[str, str]:
    return ORACLES


