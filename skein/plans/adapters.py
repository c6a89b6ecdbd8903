"""The test tables as inputs of the operators, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import IntervalConfig
from ..functions.scalars import num
from ..operators import series

CFG = IntervalConfig()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: a user is a track, an event a frame. They are dealt out by user once, which serves all that works by track."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return series.deal(table(spark, sf_dir, "events"), "user_id").select(
        F.col("user_id").alias("track_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), (F.col("value") + num(55)).alias("f0_hz"),
        (F.col("event_type") != "error").alias("voiced_flag"), (((F.col("event_id") * 7919) % 1000).cast("double") / num(1000)).alias("energy"),
        F.col("value").alias("h_power"), ((F.col("event_id") * 31) % 40).cast("double").alias("p_power"),
    )


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.cut_evenly(frames(spark, sf_dir).where("track_id IS NOT NULL"), CFG.segment_length, CFG.segments)


FRAMES_SQL = """
frames AS (
  SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value + 55 AS f0_hz,
         event_type <> 'error' AS voiced_flag, CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS energy, value AS h_power, CAST((event_id * 31) % 40 AS DOUBLE) AS p_power
  FROM events),
lens AS (SELECT track_id, count(*) AS n FROM frames GROUP BY 1),
starts AS (
  SELECT track_id, n, CAST(i AS INTEGER) AS seg_idx,
         CAST(CASE WHEN n <= 20 THEN 0 WHEN i = 3 THEN n - 20 ELSE floor(i * (CAST(n - 20 AS DOUBLE) / 3)) END AS BIGINT) AS start
  FROM lens, range(4) r(i) WHERE i = 0 OR n > 20),
sf AS (SELECT f.*, s.seg_idx FROM frames f JOIN starts s ON f.track_id = s.track_id AND f.frame_idx >= s.start AND f.frame_idx < s.start + 20)"""

CHAIN_SQL = (
    "WITH "
    + FRAMES_SQL.strip()
    + """,
vm AS (SELECT *, f0_hz IS NOT NULL AND NOT isnan(f0_hz) AND voiced_flag AND energy >= quantile_cont(energy, 0.2) OVER (PARTITION BY track_id, seg_idx) AS v FROM sf),
isl AS (SELECT *, row_number() OVER (PARTITION BY track_id, seg_idx ORDER BY frame_idx) - row_number() OVER (PARTITION BY track_id, seg_idx, v ORDER BY frame_idx) AS k FROM vm),
sup AS (SELECT *, v AND count(*) OVER (PARTITION BY track_id, seg_idx, v, k) >= 3 AS voiced FROM isl),
sums AS (
  SELECT track_id, seg_idx, avg(CAST(voiced AS INTEGER)) AS voiced_ratio, sum(CAST(voiced AS INTEGER)) AS n_voiced, sum(CAST(voiced AND f0_hz > 0 AS INTEGER)) AS n_pitch,
         count(*) AS n_frames, sqrt(avg(h_power)) + 1e-12 AS h, sqrt(avg(p_power)) + 1e-12 AS p FROM sup GROUP BY 1, 2),
gate AS (
  SELECT *, h / (h + p + 1e-9) AS harmonic_ratio, NOT (voiced_ratio < 0.3 OR n_voiced < 6 OR h / (h + p + 1e-9) < 0.55 OR n_pitch < 6) AS pitched FROM sums),
midi AS (SELECT s.track_id, s.seg_idx, s.frame_idx, log2(f0_hz / 440) * 12 + 69 AS m FROM sup s JOIN gate g ON s.track_id = g.track_id AND s.seg_idx = g.seg_idx AND g.pitched WHERE s.voiced AND f0_hz > 0),
notes AS (
  SELECT track_id, seg_idx, frame_idx, CAST(floor((((m % 12) + 12) % 12) * 2) AS INTEGER) % 24 AS pc,
         row_number() OVER (PARTITION BY track_id, seg_idx ORDER BY frame_idx DESC) <= greatest(1, ceil(count(*) OVER (PARTITION BY track_id, seg_idx) * CAST(0.15 AS DOUBLE))) AS tail FROM midi),
scores AS (SELECT track_id, seg_idx, pc, count(*) + CAST(0.5 AS DOUBLE) * sum(CAST(tail AS INTEGER)) AS score FROM notes GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY track_id, seg_idx ORDER BY score DESC, pc) AS r FROM scores),
tonics AS (
  SELECT track_id, seg_idx, max(CASE WHEN r = 1 THEN pc END) AS tonic, max(CASE WHEN r = 1 THEN score END) AS top1, coalesce(max(CASE WHEN r = 2 THEN score END), 0) AS top2 FROM ranked GROUP BY 1, 2),
itv AS (SELECT n.*, (pc - tonic + 24) % 24 AS itv FROM notes n JOIN tonics USING (track_id, seg_idx)),
pairs AS (SELECT *, lag(itv) OVER (PARTITION BY track_id, seg_idx ORDER BY frame_idx) AS previous, count(*) OVER (PARTITION BY track_id, seg_idx) AS total FROM itv),
stepped AS (SELECT *, CASE WHEN total = 1 THEN 0 ELSE greatest(least(((itv - previous + 12) % 24 + 24) % 24 - 12, 12), -12) END AS step FROM pairs),
lagged AS (SELECT track_id, seg_idx, frame_idx, itv, CASE WHEN itv = lag(itv) OVER (PARTITION BY track_id, seg_idx ORDER BY frame_idx) THEN 0 ELSE 1 END AS change FROM itv),
islands AS (SELECT *, sum(change) OVER (PARTITION BY track_id, seg_idx ORDER BY frame_idx) AS run FROM lagged),
runs AS (SELECT track_id, seg_idx, run, itv, count(*) AS length FROM islands GROUP BY 1, 2, 3, 4),
hist AS (SELECT track_id, seg_idx, itv, count(*) AS n FROM itv GROUP BY 1, 2, 3),
histv AS (SELECT *, n / (sum(n) OVER (PARTITION BY track_id, seg_idx) + 1e-9) AS value FROM hist),
trans AS (SELECT track_id, seg_idx, previous, itv, count(*) AS n FROM pairs WHERE previous IS NOT NULL GROUP BY 1, 2, 3, 4),
transv AS (SELECT *, n / (sum(n) OVER (PARTITION BY track_id, seg_idx) + 1e-9) AS value FROM trans),
cad AS (SELECT track_id, seg_idx, itv, count(*) AS n FROM itv WHERE tail GROUP BY 1, 2, 3),
cadv AS (SELECT *, n / (sum(n) OVER (PARTITION BY track_id, seg_idx) + 1e-9) AS value FROM cad),
stp AS (SELECT track_id, seg_idx, step, count(*) AS n FROM stepped WHERE step IS NOT NULL AND (previous IS NOT NULL OR total = 1) GROUP BY 1, 2, 3),
stpv AS (SELECT *, n / (sum(n) OVER (PARTITION BY track_id, seg_idx) + 1e-9) AS value FROM stp),
bucketed AS (SELECT *, CASE WHEN length <= 1 THEN 0 WHEN length <= 2 THEN 1 WHEN length <= 3 THEN 2 WHEN length <= 4 THEN 3 WHEN length <= 6 THEN 4 WHEN length <= 8 THEN 5 WHEN length <= 12 THEN 6 ELSE 7 END AS bucket FROM runs),
dur AS (SELECT track_id, seg_idx, bucket, count(*) AS n FROM bucketed GROUP BY 1, 2, 3),
durv AS (SELECT *, n / (sum(n) OVER (PARTITION BY track_id, seg_idx) + 1e-9) AS value FROM dur),
steps1 AS (
  SELECT track_id, seg_idx, count(*) AS notes, avg(abs(step)) FILTER (previous IS NOT NULL OR total = 1) / 12 AS step_mean, stddev_pop(step) FILTER (previous IS NOT NULL OR total = 1) / 12 AS step_std,
         sum(CAST(tail AND itv = 0 AS INTEGER)) / (sum(CAST(tail AS INTEGER)) + 1e-9) AS cadence_to_tonic FROM stepped GROUP BY 1, 2),
scalars AS (
  SELECT g.track_id, g.seg_idx, g.pitched, g.voiced_ratio, g.harmonic_ratio, coalesce((top1 - top2) / (top1 + 1e-9), 0) AS tonic_strength, coalesce(cadence_to_tonic, 0) AS cadence_to_tonic,
         coalesce(step_mean, 0) AS step_mean, coalesce(step_std, 0) AS step_std, coalesce(CAST(notes AS DOUBLE) / n_frames, 0) AS note_density, CAST(g.pitched AS DOUBLE) AS is_pitched
  FROM gate g LEFT JOIN tonics USING (track_id, seg_idx) LEFT JOIN steps1 USING (track_id, seg_idx)),
profile AS (
  SELECT track_id, seg_idx, 'hist' AS feature, CAST(itv AS INTEGER) AS idx, value FROM histv
  UNION ALL SELECT track_id, seg_idx, 'trans', CAST(previous * 24 + itv AS INTEGER), value FROM transv
  UNION ALL SELECT track_id, seg_idx, 'cadence', CAST(itv AS INTEGER), value FROM cadv
  UNION ALL SELECT track_id, seg_idx, 'step', CAST(step + 12 AS INTEGER), value FROM stpv
  UNION ALL SELECT track_id, seg_idx, 'duration', CAST(bucket AS INTEGER), value FROM durv
  UNION ALL SELECT track_id, seg_idx, 'scalar', CAST(i AS INTEGER), [voiced_ratio, harmonic_ratio, tonic_strength, cadence_to_tonic, step_mean, step_std, note_density, is_pitched][i + 1] FROM scalars, range(8) r(i)),
counts AS (SELECT track_id, count(*) AS n_all, sum(CAST(pitched AS INTEGER)) AS n_good, avg(CAST(pitched AS DOUBLE)) AS valid, avg(voiced_ratio) AS voiced, avg(harmonic_ratio) AS harmonic FROM gate GROUP BY 1),
pooled AS (
  SELECT p.track_id, feature, idx, sum(value) / max(CASE WHEN n_good > 0 THEN n_good ELSE n_all END) AS value
  FROM profile p JOIN gate g ON p.track_id = g.track_id AND p.seg_idx = g.seg_idx JOIN counts c ON p.track_id = c.track_id WHERE g.pitched OR n_good = 0 GROUP BY 1, 2, 3
  UNION ALL SELECT track_id, 'track', CAST(i AS INTEGER), [valid, voiced, harmonic][i + 1] FROM counts, range(3) r(i))
"""
)
