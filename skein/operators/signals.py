"""Signals as tables: frames, spectra, and linear maps of spectra.

Arrays stay arrays while frames are cut; per-bin work is long (series_id, frame_idx, bin, value) and grouped by the series,
so every window has a series or a frame as its partition. Only the Fourier transform and the pitch estimate run in
Python, over Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import num, total
from . import series

KEYS = ["series_id", "frame_idx"]


def frame_signal(signals: DataFrame, n_fft: int, hop: int, center: bool = False) -> DataFrame:
    """series_id, frame_idx, frame: hopping windows of n_fft samples; a signal that is too short is padded with zeros."""
    pad = F.array_repeat(num(0), n_fft // 2)
    x = F.concat(pad, "samples", pad) if center else F.col("samples")
    x = F.when(F.size(x) < n_fft, F.concat(x, F.array_repeat(num(0), n_fft - F.size(x)))).otherwise(x)
    rows = signals.select("series_id", x.alias("_x"))
    begin = F.posexplode(F.sequence(F.lit(0), F.size("_x") - n_fft, F.lit(hop))).alias("frame_idx", "_at")
    return rows.select("series_id", "_x", begin).select("series_id", "frame_idx", F.slice("_x", F.col("_at") + 1, n_fft).alias("frame"))


def frame_rms(frames: DataFrame) -> DataFrame:
    power = total(F.transform("frame", lambda x: x * x)) / F.size("frame")
    return frames.select(*KEYS, (F.sqrt(power) + num(1e-12)).alias("rms"))


def trim_silence(rms: DataFrame, top_db: float) -> DataFrame:
    """Frames between the first and the last that are within top_db of the peak."""
    by = W.partitionBy("series_id")
    loud = num(20) * F.log10(F.col("rms") / F.max("rms").over(by)) >= -top_db
    marked = rms.withColumn("_loud", loud)
    first, last = (f(F.when(F.col("_loud"), F.col("frame_idx"))).over(by) for f in (F.min, F.max))
    return marked.withColumn("_a", first).withColumn("_b", last).where("frame_idx BETWEEN _a AND _b").drop("_loud", "_a", "_b")


def power_spectrum(frames: DataFrame, n_fft: int, window: str = "hann") -> DataFrame:
    """series_id, frame_idx, bin, value: |rfft|^2 of each windowed frame."""
    weights = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft) if window == "hann" else np.ones(n_fft)

    @F.pandas_udf("array<double>")
    def power(frame: pd.Series) -> pd.Series:
        if not len(frame):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.abs(np.fft.rfft(np.stack(frame.to_numpy()) * weights, axis=1)) ** 2))

    return frames.select(*KEYS, F.posexplode(power("frame")).alias("bin", "value"))


def matrix_rows(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """o, i, w of what isn't zero: a table of fixed size, made once."""
    o, i = np.nonzero(matrix)
    return spark.createDataFrame(list(zip(o.tolist(), i.tolist(), matrix[o, i].tolist(), strict=True)), "o int, i int, w double")


def linear_map(df: DataFrame, keys: list[str], idx: str, value: str, matrix: np.ndarray) -> DataFrame:
    """keys, o, value: out[o] = sum of matrix[o, i] * value[i]."""
    rows = F.broadcast(matrix_rows(df.sparkSession, matrix))  # as many rows as the matrix has entries
    return df.join(rows, F.col(idx) == F.col("i")).groupBy(*keys, "o").agg(F.sum(F.col("w") * F.col(value)).alias("value"))


def power_db(df: DataFrame, value: str, by: list[str], top_db: float = 80.0) -> DataFrame:
    """value in decibels under the largest of the group, no lower than top_db under it."""
    peak = F.max(value).over(W.partitionBy(*by))
    db = num(10) * F.log10(F.greatest(value, num(1e-10))) - num(10) * F.log10(F.greatest(peak, num(1e-10)))
    return df.withColumn("db", F.greatest(db, num(-top_db)))


def hpss(spectrum: DataFrame, half: int) -> DataFrame:
    """Adds harmonic and percussive parts: medians along time and along bins, as soft masks."""
    rows = series.moving_median(spectrum, "value", "_h", half, ["series_id", "bin"], "frame_idx")
    rows = series.moving_median(rows, "value", "_p", half, KEYS, "bin")
    h2, p2 = F.col("_h") * F.col("_h"), F.col("_p") * F.col("_p")
    mask = F.when(h2 + p2 > 0, h2 / (h2 + p2)).otherwise(num(0.5))
    return rows.withColumn("_m", mask).withColumn("harmonic", F.col("value") * F.col("_m")).withColumn("percussive", F.col("value") * (num(1) - F.col("_m"))).drop("_h", "_p", "_m")


def harmonic_share(parts: DataFrame) -> DataFrame:
    h, p = F.sqrt(F.avg("harmonic")) + num(1e-12), F.sqrt(F.avg("percussive")) + num(1e-12)
    return parts.groupBy("series_id").agg((h / (h + p + num(1e-9))).alias("harmonic_ratio"))


def _mel(hz):
    """Slaney's scale: linear to 1000 Hz, then logarithmic."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def _hz(mel):
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


def mel_matrix(rate: int, n_fft: int, bands: int, low: float, high: float) -> np.ndarray:
    """Triangles between equally spaced mels, each of unit area."""
    edges = _hz(np.linspace(_mel(low), _mel(high), bands + 2))
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    rise = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def dct_matrix(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal type II."""
    out = np.cos(np.pi * np.arange(n_out)[:, None] * (np.arange(n_in) + 0.5)[None] / n_in) * math.sqrt(2 / n_in)
    out[0] /= math.sqrt(2)
    return out


def chroma_matrix(rate: int, n_fft: int, classes: int = 12) -> np.ndarray:
    """Each bin but the first goes to the class of its rounded note."""
    f = np.arange(1, n_fft // 2 + 1) * rate / n_fft
    out = np.zeros((classes, n_fft // 2 + 1))
    out[np.mod(np.floor(12 * np.log2(f / 440) + 69 + 0.5).astype(int), classes), np.arange(1, n_fft // 2 + 1)] = 1
    return out


def tonnetz_matrix() -> np.ndarray:
    """Fifths, minor thirds and major thirds as points on three circles."""
    pitch = np.arange(12)
    rows = []
    for turns, radius in ((7 / 6, 1.0), (3 / 2, 1.0), (2 / 3, 0.5)):
        rows += [radius * np.sin(np.pi * turns * pitch), radius * np.cos(np.pi * turns * pitch)]
    return np.array(rows)


def mel_db(spectrum: DataFrame, rate: int, n_fft: int, bands: int = 128, low: float = 20, high: float = 8000) -> DataFrame:
    """series_id, frame_idx, o (band), db."""
    mel = linear_map(spectrum, KEYS, "bin", "value", mel_matrix(rate, n_fft, bands, low, high))
    return power_db(mel, "value", ["series_id"])


def mfcc(mels: DataFrame, bands: int, n: int = 20) -> DataFrame:
    return linear_map(mels.select(*KEYS, F.col("o").alias("band"), "db"), KEYS, "band", "db", dct_matrix(n, bands))


def delta(df: DataFrame, value: str, by: list[str], half: int = 4) -> DataFrame:
    return df.withColumn("delta", series.slope(value, half, by, "frame_idx"))


def chroma(spectrum: DataFrame, rate: int, n_fft: int) -> DataFrame:
    """series_id, frame_idx, o (class), value: over the frame's largest class."""
    rows = linear_map(spectrum, KEYS, "bin", "value", chroma_matrix(rate, n_fft))
    peak = F.max("value").over(W.partitionBy(*KEYS))
    return rows.withColumn("value", F.when(peak > 0, F.col("value") / peak).otherwise(num(0)))


def contrast(spectrum: DataFrame, edges: list[int], share: float = 0.02) -> DataFrame:
    """series_id, frame_idx, band, contrast: decibels between the means of the strongest and weakest share of a band's bins."""
    band = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("bin")))
    by = W.partitionBy(*KEYS, "band")
    rows = spectrum.withColumn("band", band).withColumn("_r", F.row_number().over(by.orderBy("value", "bin"))).withColumn("_n", F.count(F.lit(1)).over(by))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * num(share) + num(0.5)))
    low, high = F.avg(F.when(F.col("_r") <= k, F.col("value"))), F.avg(F.when(F.col("_r") > F.col("_n") - k, F.col("value")))
    db = lambda x: num(10) * F.log10(F.greatest(x, num(1e-10)))
    return rows.groupBy(*KEYS, "band").agg((db(high) - db(low)).alias("contrast"))


def tonnetz(chromas: DataFrame) -> DataFrame:
    whole = F.sum(F.abs("value")).over(W.partitionBy(*KEYS))
    shares = chromas.withColumn("value", F.when(whole > 0, F.col("value") / whole).otherwise(num(0)))
    return linear_map(shares.select(*KEYS, F.col("o").alias("class"), "value"), KEYS, "class", "value", tonnetz_matrix())


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, mean, std (of the population)."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def segment_vector(spectrum: DataFrame, harmonic: DataFrame, rate: int, n_fft: int, edges: list[int], share: float = 0.02, bands: int = 128, coefficients: int = 20, half: int = 4, mode: DataFrame | None = None) -> DataFrame:
    """series_id, feature, idx, value: means, then deviations, over a segment's frames, of mel bands, cepstral coefficients and their
    slopes, chroma, contrast and (from the harmonic part) tonnetz; with `mode` (series_id, feature, idx, value) those features too.

    A slope at the ends of a segment is that of the nearest frame with all its neighbours, as a line fitted there gives."""
    mels = mel_db(spectrum, rate, n_fft, bands)
    ceps = mfcc(mels, bands, coefficients)
    slopes = delta(ceps, "value", ["series_id", "o"], half)
    by = W.partitionBy("series_id", "o").orderBy("frame_idx")
    filled = F.coalesce("delta", F.last("delta", True).over(by), F.first("delta", True).over(by.rowsBetween(0, W.unboundedFollowing)), num(0))
    blocks = [
        (mels, "o", {"mel": F.col("db")}), (slopes, "o", {"mfcc": F.col("value"), "delta": filled}), (chroma(spectrum, rate, n_fft), "o", {"chroma": F.col("value")}),
        (contrast(spectrum, edges, share), "band", {"contrast": F.col("contrast")}), (tonnetz(chroma(harmonic, rate, n_fft)), "o", {"tonnetz": F.col("value")}),
    ]
    width = {"mel": bands, "mfcc": coefficients, "delta": coefficients, "chroma": 12, "contrast": len(edges) + 1, "tonnetz": 6}
    stats = None
    for block, o, values in blocks:  # summed up before they meet: a few rows a series instead of some for each frame
        rows = block.select("series_id", F.col(o).cast("int").alias("o"), *[x.alias(name) for name, x in values.items()])
        sums = rows.groupBy("series_id", "o").agg(*[F.struct(F.lit(name).alias("feature"), F.lit(width[name]).alias("_w"), F.avg(name).alias("mean"), F.stddev_pop(name).alias("std")).alias(name) for name in values])
        one = sums.select("series_id", "o", F.explode(F.array(*values)).alias("_s")).select("series_id", "o", "_s.*")
        stats = one if stats is None else stats.unionByName(one)
    out = stats.select("series_id", "feature", F.explode(F.array(F.struct(F.col("o").alias("idx"), F.col("mean").alias("value")), F.struct((F.col("o") + F.col("_w")).alias("idx"), F.col("std").alias("value")))).alias("e"))
    out = out.select("series_id", "feature", "e.idx", "e.value")
    return out if mode is None else out.unionByName(mode.select("series_id", "feature", F.col("idx").cast("int").alias("idx"), "value"))


def yin(signals: DataFrame, low: float, high: float, threshold: float = 0.1) -> DataFrame:
    """series_id, frame_idx, f0_hz, voiced_flag: the cumulative-mean-normalised difference of each frame; the first lag under
    the threshold (down to its local minimum), else the lag of the least value, then unvoiced.

    signals: series_id, frame_idx, sample_rate, frame."""

    @F.pandas_udf("struct<f0_hz: double, voiced_flag: boolean>")
    def estimate(frame: pd.Series, rate: pd.Series) -> pd.DataFrame:
        out = []
        for x, r in zip(frame, rate, strict=True):
            x = np.asarray(x, float)
            lo, hi = max(1, int(r / high)), min(len(x) - 1, math.ceil(r / low))
            if hi <= lo:
                out.append((None, False))
                continue
            w, size = len(x) - hi, 1 << (2 * len(x) - 1).bit_length()
            # The sum of squared differences at each lag: two energies, less twice the correlation (by Fourier transform).
            energy = np.concatenate([[0.0], np.cumsum(x * x)])
            both = np.fft.irfft(np.conj(np.fft.rfft(x[:w], size)) * np.fft.rfft(x, size), size)[: hi + 1]
            d = np.maximum(energy[w] + energy[w : w + hi + 1] - energy[: hi + 1] - 2 * both, 0.0)
            running = np.cumsum(d[1:])
            norm = np.concatenate([[1.0], np.where(running > 0, d[1:] * np.arange(1, hi + 1) / np.maximum(running, 1e-300), 1.0)])
            under = np.flatnonzero(norm[lo : hi + 1] < threshold)
            k = lo + (int(under[0]) if len(under) else int(np.argmin(norm[lo : hi + 1])))
            while len(under) and k + 1 <= hi and norm[k + 1] < norm[k]:
                k += 1
            out.append((float(r) / k, bool(len(under))))
        return pd.DataFrame(out, columns=["f0_hz", "voiced_flag"])

    return signals.select(*KEYS, estimate("frame", "sample_rate").alias("_e")).select(*KEYS, "_e.f0_hz", "_e.voiced_flag")
