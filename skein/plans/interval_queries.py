"""Queries of the interval family, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModeConfig
from ..functions.scalars import is_number, midi, num, pitch_class
from ..operators import intervals as iv
from ..operators import series
from .adapters import CFG, CHAIN_SQL, FRAMES_SQL, frames, segmented, table

G = ["track_id", "seg_idx"]


def r6(name: str, out: str | None = None):
    return F.round(name, 6).alias(out or name)


def _voiced(spark: SparkSession, d: str) -> DataFrame:
    return iv.voiced_frames(segmented(spark, d), CFG)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    """A row a segment, from which all histograms come: no window, no join, no second scan."""
    return iv.packed(_voiced(spark, d), CFG)


def segment_starts_even(spark, d):
    return series.even_starts(series.lengths(frames(spark, d)), 70, 4).select("track_id", "seg_idx", "start")


def segment_starts_random(spark, d):
    return series.random_starts(series.lengths(frames(spark, d)), 20, 4, F.col("track_id").cast("string")).select("track_id", "seg_idx", "start")


def segment_frames(spark, d):
    return segmented(spark, d).select("track_id", "seg_idx", "frame_idx", r6("f0_hz"))


def voiced_mask(spark, d):
    return iv.voiced_mask(segmented(spark, d), CFG).select("track_id", "seg_idx", "frame_idx", "v")


def short_run_suppress(spark, d):
    return _voiced(spark, d).select("track_id", "seg_idx", "frame_idx", "v", "voiced")


def segment_gate(spark, d):
    return iv.gate(_voiced(spark, d), CFG).select(*G, r6("voiced_ratio"), r6("harmonic_ratio"), F.col("n_voiced").cast("long").alias("n_voiced"), "pitched")


def harmonic_ratio(spark, d):
    return iv.gate(_voiced(spark, d), CFG).select(*G, r6("harmonic_ratio"))


def pitch_class_query(spark, d):
    hz = F.col("f0_hz")
    good = frames(spark, d).where(is_number(hz) & (hz > 0))
    return good.select("track_id", "frame_idx", F.round(midi(hz), 6).alias("midi"), pitch_class(hz, 24).alias("pc"))


def tonic_intervals(spark, d):
    notes = F.transform("itv", lambda x, i: F.struct(F.get("_notes", i)["frame_idx"].alias("frame_idx"), F.get("_pc", i).alias("pc"), x.cast("int").alias("itv")))
    return _packed(spark, d).select(*G, F.explode(notes).alias("e")).select(*G, "e.*")


def tonic_strength(spark, d):
    return _packed(spark, d).where("pitched").select(*G, F.col("_tonic").alias("tonic"), r6("tonic_strength"))


def interval_hist(spark, d):
    """All classes of a pitched segment, those that don't occur included."""
    every = F.transform(F.sequence(F.lit(0), F.lit(CFG.bins - 1)), lambda i: F.struct(i.alias("itv"), F.size(F.filter("itv", lambda x: x == i)).cast("long").alias("n")))
    rows = _packed(spark, d).where("pitched").select(*G, "_n", F.explode(every).alias("e"))
    return rows.select(*G, "e.itv", "e.n", F.round(F.col("e.n") / (F.col("_n") + num(iv.EPS)), 6).alias("value"))


def interval_transitions(spark, d):
    return iv.entry_counts(_packed(spark, d), "_moves", "previous", "itv").select(*G, F.col("previous").cast("int").alias("previous"), F.col("itv").cast("int").alias("itv"), "n", r6("value"))


def cadence_hist(spark, d):
    return iv.entry_counts(_packed(spark, d), "_end", "itv").select(*G, F.col("itv").cast("int").alias("itv"), "n", r6("value"))


def step_hist(spark, d):
    return iv.entry_counts(_packed(spark, d), "_steps", "step").select(*G, F.col("step").cast("int").alias("step"), "n", r6("value"))


def duration_hist(spark, d):
    return iv.entry_counts(_packed(spark, d), iv.duration_buckets(8), "bucket").select(*G, "bucket", "n", r6("value"))


def duration_hist_quantile(spark, d):
    return iv.entry_counts(_packed(spark, d), iv.duration_buckets(6), "bucket").select(*G, "bucket", "n", r6("value"))


def segment_scalars(spark, d):
    return iv.scalars(_voiced(spark, d), CFG).select(*G, *[r6(c) for c in iv.SCALARS])


def interval_profile(spark, d):
    return iv.profile(_voiced(spark, d), CFG).select(*G, "feature", "idx", r6("value"))


def track_pooling(spark, d):
    return iv.pool(iv.segment_features(_voiced(spark, d), CFG)).select("track_id", "feature", "idx", r6("value"))


def track_features(spark, d):
    """Dense vectors of all customers, those without events included, as long rows of what isn't zero and the size."""
    everyone = table(spark, d, "customer").select(F.col("c_custkey").alias("track_id"))
    vectors = iv.track_features(frames(spark, d), everyone, CFG)
    long = vectors.select("track_id", F.size("features").alias("size"), F.posexplode("features").alias("idx", "value"))
    return long.where("value <> 0 OR idx = 0").select("track_id", "size", "idx", r6("value"))


def feature_vector_long(spark, d):
    held = _voiced(spark, d)
    vectors = iv.dense(iv.profile(held, CFG), CFG.segment_size, iv.place(CFG), G)
    long = vectors.select(*G, F.size("features").alias("size"), F.posexplode("features").alias("idx", "value"))
    return long.where("value <> 0").select(*G, "size", "idx", r6("value"))


def mode_features(spark, d):
    return iv.mode_features(segmented(spark, d), ModeConfig()).select(*G, "feature", "idx", r6("value"))


def _sql(select: str) -> str:
    return CHAIN_SQL + select


_VALUE = "CAST(n AS BIGINT) AS n, round(value, 6) AS value"
_PLACE = "CASE feature WHEN 'hist' THEN 0 WHEN 'trans' THEN 24 WHEN 'cadence' THEN 600 WHEN 'step' THEN 624 WHEN 'duration' THEN 649 WHEN 'scalar' THEN 657 ELSE 665 END + idx"

ORACLES = {
    "segment_starts_even": "WITH " + FRAMES_SQL.strip() + """
        SELECT track_id, CAST(i AS INTEGER) AS seg_idx, CAST(CASE WHEN n <= 70 THEN 0 WHEN i = 3 THEN n - 70 ELSE floor(i * (CAST(n - 70 AS DOUBLE) / 3)) END AS BIGINT) AS start
        FROM lens, range(4) r(i) WHERE i = 0 OR n > 70""",
    "segment_starts_random": "WITH " + FRAMES_SQL.strip() + """
        SELECT track_id, CAST(i AS INTEGER) AS seg_idx,
               CASE WHEN n <= 20 THEN 0 ELSE ('0x' || substr(md5(track_id || '|42|' || i), 1, 8))::BIGINT % (n - 19) END AS start
        FROM lens, range(4) r(i) WHERE i = 0 OR n > 20""",
    "segment_frames": "WITH " + FRAMES_SQL.strip() + " SELECT track_id, seg_idx, frame_idx, round(f0_hz, 6) AS f0_hz FROM sf",
    "voiced_mask": _sql("SELECT track_id, seg_idx, frame_idx, v FROM vm"),
    "short_run_suppress": _sql("SELECT track_id, seg_idx, frame_idx, v, voiced FROM sup"),
    "segment_gate": _sql("SELECT track_id, seg_idx, round(voiced_ratio, 6) AS voiced_ratio, round(harmonic_ratio, 6) AS harmonic_ratio, CAST(n_voiced AS BIGINT) AS n_voiced, pitched FROM gate"),
    "harmonic_ratio": _sql("SELECT track_id, seg_idx, round(harmonic_ratio, 6) AS harmonic_ratio FROM gate"),
    "pitch_class": "WITH " + FRAMES_SQL.strip() + """, m AS (SELECT track_id, frame_idx, log2(f0_hz / 440) * 12 + 69 AS midi FROM frames WHERE NOT isnan(f0_hz) AND f0_hz > 0)
        SELECT track_id, frame_idx, round(midi, 6) AS midi, CAST(floor((((midi % 12) + 12) % 12) * 2) AS INTEGER) % 24 AS pc FROM m""",
    "tonic_intervals": _sql("SELECT track_id, seg_idx, frame_idx, pc, itv FROM itv"),
    "tonic_strength": _sql("SELECT track_id, seg_idx, tonic, round((top1 - top2) / (top1 + 1e-9), 6) AS tonic_strength FROM tonics"),
    "interval_hist": _sql("""SELECT s.track_id, s.seg_idx, CAST(i AS INTEGER) AS itv, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(value, 0), 6) AS value
        FROM (SELECT DISTINCT track_id, seg_idx FROM hist) s CROSS JOIN range(24) r(i) LEFT JOIN histv h ON h.track_id = s.track_id AND h.seg_idx = s.seg_idx AND h.itv = i"""),
    "interval_transitions": _sql(f"SELECT track_id, seg_idx, previous, itv, {_VALUE} FROM transv"),
    "cadence_hist": _sql(f"SELECT track_id, seg_idx, itv, {_VALUE} FROM cadv"),
    "step_hist": _sql(f"SELECT track_id, seg_idx, step, {_VALUE} FROM stpv"),
    "duration_hist": _sql(f"SELECT track_id, seg_idx, CAST(bucket AS INTEGER) AS bucket, {_VALUE} FROM durv"),
    "duration_hist_quantile": CHAIN_SQL.rstrip() + """,
        edges AS (SELECT track_id, seg_idx, [quantile_cont(length, 0.25), quantile_cont(length, 0.5), quantile_cont(length, 0.75)] AS e FROM runs GROUP BY 1, 2),
        put AS (SELECT r.track_id, r.seg_idx, CAST(len(list_filter(e, lambda x: x < length)) AS INTEGER) AS bucket FROM runs r JOIN edges USING (track_id, seg_idx)),
        cnt AS (SELECT track_id, seg_idx, bucket, count(*) AS n FROM put GROUP BY 1, 2, 3)
        SELECT track_id, seg_idx, bucket, n, round(n / (sum(n) OVER (PARTITION BY track_id, seg_idx) + 1e-9), 6) AS value FROM cnt""",
    "segment_scalars": _sql("SELECT track_id, seg_idx, " + ", ".join(f"round({c}, 6) AS {c}" for c in iv.SCALARS) + " FROM scalars"),
    "interval_profile": _sql("SELECT track_id, seg_idx, feature, idx, round(value, 6) AS value FROM profile"),
    "track_pooling": _sql("SELECT track_id, feature, idx, round(value, 6) AS value FROM pooled"),
    "track_features": CHAIN_SQL.rstrip() + f""",
        flat AS (SELECT track_id, CAST({_PLACE} AS INTEGER) AS idx, value FROM pooled WHERE value <> 0),
        wanted AS (SELECT c_custkey AS track_id FROM customer),
        both_ AS (SELECT track_id, idx, value FROM flat WHERE track_id IN (SELECT track_id FROM wanted)
                  UNION ALL SELECT track_id, 0, 0 FROM wanted WHERE track_id NOT IN (SELECT track_id FROM flat WHERE idx = 0))
        SELECT track_id, 668 AS size, idx, round(value, 6) AS value FROM both_""",
    "feature_vector_long": _sql(f"SELECT track_id, seg_idx, 665 AS size, CAST({_PLACE} AS INTEGER) AS idx, round(value, 6) AS value FROM profile WHERE value <> 0"),
    "mode_features": "WITH " + FRAMES_SQL.strip() + """,
        mk AS (SELECT *, f0_hz IS NOT NULL AND NOT isnan(f0_hz) AND voiced_flag AS voiced FROM sf),
        base AS (SELECT track_id, seg_idx, avg(CAST(voiced AS INTEGER)) AS voiced_ratio, sum(CAST(voiced AS INTEGER)) AS nv FROM mk GROUP BY 1, 2),
        m AS (SELECT mk.track_id, mk.seg_idx, frame_idx, f0_hz, log2(f0_hz / 440) * 12 + 69 AS m FROM mk JOIN base b ON b.track_id = mk.track_id AND b.seg_idx = mk.seg_idx AND nv >= 4 WHERE voiced AND f0_hz > 0),
        rows_ AS (SELECT track_id, seg_idx, f0_hz, CAST(floor((((m % 12) + 12) % 12) * 2) AS INTEGER) % 24 AS pc,
                         row_number() OVER (PARTITION BY track_id, seg_idx ORDER BY frame_idx DESC) <= greatest(1, ceil(count(*) OVER (PARTITION BY track_id, seg_idx) * CAST(0.1 AS DOUBLE))) AS tail,
                         median(f0_hz) OVER (PARTITION BY track_id, seg_idx) AS med FROM m),
        h AS (SELECT track_id, seg_idx, pc, count(*) AS n FROM rows_ GROUP BY 1, 2, 3),
        hv AS (SELECT *, n / (sum(n) OVER (PARTITION BY track_id, seg_idx) + 1e-9) AS value, row_number() OVER (PARTITION BY track_id, seg_idx ORDER BY n DESC, pc) AS r FROM h),
        t AS (SELECT track_id, seg_idx, max(CASE WHEN r = 1 THEN pc END) AS tonic, max(CASE WHEN r = 1 THEN value END) - coalesce(max(CASE WHEN r = 2 THEN value END), 0) AS strength FROM hv GROUP BY 1, 2),
        i AS (SELECT r.track_id, r.seg_idx, (pc - tonic + 24) % 24 AS itv, count(*) AS n FROM rows_ r JOIN t USING (track_id, seg_idx) GROUP BY 1, 2, 3),
        c AS (SELECT track_id, seg_idx, pc, count(*) AS n FROM rows_ WHERE tail GROUP BY 1, 2, 3),
        cv AS (SELECT *, n / (sum(n) OVER (PARTITION BY track_id, seg_idx) + 1e-9) AS value FROM c),
        sd AS (SELECT track_id, seg_idx, stddev_pop(1200 * log2(greatest(f0_hz, 1e-9) / greatest(med, 1e-9))) AS spread FROM rows_ GROUP BY 1, 2),
        one AS (SELECT b.track_id, b.seg_idx, voiced_ratio, coalesce(strength, 0) AS strength, coalesce(spread, 0) AS spread, coalesce(cv.value, 0) AS ending
                FROM base b LEFT JOIN t USING (track_id, seg_idx) LEFT JOIN sd USING (track_id, seg_idx) LEFT JOIN cv ON cv.track_id = b.track_id AND cv.seg_idx = b.seg_idx AND cv.pc = t.tonic)
        SELECT track_id, seg_idx, 'pitch' AS feature, pc AS idx, round(value, 6) AS value FROM hv
        UNION ALL SELECT track_id, seg_idx, 'interval', CAST(itv AS INTEGER), round(n / (sum(n) OVER (PARTITION BY track_id, seg_idx) + 1e-9), 6) FROM i
        UNION ALL SELECT track_id, seg_idx, 'cadence', pc, round(value, 6) FROM cv
        UNION ALL SELECT track_id, seg_idx, 'scalar', CAST(k AS INTEGER), round([voiced_ratio, strength, spread, ending][k + 1], 6) FROM one, range(4) r(k)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: pitch_class_query if name == "pitch_class" else globals()[name] for name in ORACLES}


def oracle_sql() -> dict[str, str]:
    return ORACLES
