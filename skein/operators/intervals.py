"""Interval profiles: voiced mask, gate, reference tone, and the histograms around it.

All windows and aggregates of a segment use the keys (track_id, seg_idx), so one exchange serves them; histograms stay
sparse (feature, idx, value) until a vector is asked for. `segment_features` derives all of a segment's features from one
array of its notes; the operators before it give each of them alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import IntervalConfig, ModeConfig
from ..functions.scalars import is_number, let, num, pitch_class, total
from . import series
from .series import G

EPS = 1e-9


def segment_window():
    return W.partitionBy(*G)


def voiced_mask(frames: DataFrame, cfg: IntervalConfig, energy: bool = True) -> DataFrame:
    """Adds `v`: a finite, voiced frame that isn't among the quietest of its segment."""
    v = is_number(F.col("f0_hz")) & F.coalesce("voiced_flag", F.lit(False))
    if energy:
        v &= F.col("energy") >= F.percentile("energy", F.lit(cfg.energy_quantile)).over(segment_window())
    return frames.withColumn("v", v)


def voiced_frames(frames: DataFrame, cfg: IntervalConfig) -> DataFrame:
    """Adds `voiced`: the mask without runs shorter than cfg.min_run."""
    return series.suppress_short_runs(voiced_mask(frames, cfg), "v", "voiced", cfg.min_run)


def gate(frames: DataFrame, cfg: IntervalConfig) -> DataFrame:
    """One row per segment: ratios, counts, and whether it is pitched."""
    voiced = F.col("voiced").cast("int")
    h, p = F.sqrt(F.avg("h_power")) + num(1e-12), F.sqrt(F.avg("p_power")) + num(1e-12)
    rows = frames.groupBy(*G).agg(
        F.avg(voiced).alias("voiced_ratio"), F.sum(voiced).alias("n_voiced"), F.sum((F.col("voiced") & (F.col("f0_hz") > 0)).cast("int")).alias("n_pitch"),
        F.count(F.lit(1)).alias("n_frames"), (h / (h + p + num(EPS))).alias("harmonic_ratio"),
    )
    poor = (F.col("voiced_ratio") < cfg.min_voiced_ratio) | (F.col("n_voiced") < cfg.min_voiced) | (F.col("harmonic_ratio") < cfg.min_harmonic_ratio) | (F.col("n_pitch") < cfg.min_voiced)
    return rows.withColumn("pitched", ~poor)


def notes(frames: DataFrame, cfg: IntervalConfig) -> DataFrame:
    """Voiced frames of pitched segments: pc, tail. What follows works on these compacted rows."""
    pitched = gate(frames, cfg).where("pitched").select(*G)
    rows = frames.where("voiced AND f0_hz > 0").join(pitched, list(G), "left_semi")
    return rows.select(*G, "frame_idx", pitch_class(F.col("f0_hz"), cfg.bins).alias("pc")).withColumn("tail", series.in_tail(cfg.cadence))


def tonics(rows: DataFrame) -> DataFrame:
    """Per segment: tonic (largest count plus half the tail's, ties to the lowest class) and strength."""
    scores = rows.groupBy(*G, "pc").agg((F.count(F.lit(1)) + num(0.5) * F.sum(F.col("tail").cast("int"))).alias("score"))
    best = scores.groupBy(*G).agg(F.max_by("pc", F.struct("score", -F.col("pc"))).alias("tonic"), F.sort_array(F.collect_list("score"), asc=False).alias("_s"))
    top, second = F.col("_s")[0], F.coalesce(F.get("_s", F.lit(1)), num(0))
    return best.select(*G, "tonic", ((top - second) / (top + num(EPS))).alias("tonic_strength"))


def intervals(rows: DataFrame, cfg: IntervalConfig) -> DataFrame:
    """notes with itv, the class above the tonic, and what follows from the row before: previous, step."""
    known = rows.join(tonics(rows).select(*G, "tonic"), list(G))
    known = known.withColumn("itv", F.pmod(F.col("pc") - F.col("tonic"), F.lit(cfg.bins))).withColumn("previous", F.lag("itv").over(segment_window().orderBy("frame_idx")))
    half = cfg.bins // 2
    wrapped = F.pmod(F.col("itv") - F.col("previous") + half, F.lit(cfg.bins)) - half
    alone = F.count(F.lit(1)).over(segment_window()) == 1
    return known.withColumn("step", F.when(alone, F.lit(0)).when(F.col("previous").isNotNull(), F.greatest(F.least(wrapped, F.lit(cfg.step_clip)), F.lit(-cfg.step_clip))))


def share(counts: DataFrame, by: tuple[str, ...] = G) -> DataFrame:
    """value: the count over the group's sum plus 1e-9."""
    return counts.withColumn("value", F.col("n") / (F.sum("n").over(W.partitionBy(*by)) + num(EPS)))


def histogram(rows: DataFrame, *columns: str) -> DataFrame:
    return share(rows.groupBy(*G, *columns).agg(F.count(F.lit(1)).alias("n")))


def transitions(itv: DataFrame) -> DataFrame:
    return histogram(itv.where("previous IS NOT NULL"), "previous", "itv")


def cadences(itv: DataFrame) -> DataFrame:
    return histogram(itv.where("tail"), "itv")


def steps(itv: DataFrame) -> DataFrame:
    return histogram(itv.where("step IS NOT NULL"), "step")


def runs(itv: DataFrame) -> DataFrame:
    """One row per run of equal intervals: itv, length."""
    return series.run_lengths(itv.select(*G, "frame_idx", "itv"), "itv").groupBy(*G, "itv", "_run").agg(F.count(F.lit(1)).alias("length"))


#: The upper edges of all duration buckets but the last.
DURATION_EDGES = [1, 2, 3, 4, 6, 8, 12]


def durations(itv: DataFrame) -> DataFrame:
    bucket = F.size(F.filter(F.array(*[F.lit(x) for x in DURATION_EDGES]), lambda e: e < F.col("length")))
    return histogram(runs(itv).withColumn("bucket", bucket), "bucket")


def duration_quantiles(itv: DataFrame, n_bins: int) -> DataFrame:
    """Buckets between inner quantiles of the segment's run lengths."""
    inner = [k / (n_bins - 2) for k in range(1, n_bins - 2)]
    if not inner:
        return histogram(runs(itv).withColumn("bucket", F.lit(0)), "bucket")
    edges = F.percentile("length", F.array(*[F.lit(q) for q in inner])).over(segment_window())
    placed = runs(itv).withColumn("_edges", edges)
    return histogram(placed.withColumn("bucket", F.size(F.filter("_edges", lambda e: e < F.col("length")))), "bucket")


def scalars(frames: DataFrame, cfg: IntervalConfig) -> DataFrame:
    """The eight scalars of a segment; zero but for the two ratios where it isn't pitched."""
    rows = segment_features(frames, cfg).where("feature = 'scalar'")
    return rows.groupBy(*G).agg(*[F.max(F.when(F.col("idx") == i, F.col("value"))).alias(c) for i, c in enumerate(SCALARS)])


SCALARS = ["voiced_ratio", "harmonic_ratio", "tonic_strength", "cadence_to_tonic", "step_mean", "step_std", "note_density", "is_pitched"]


def packed(frames: DataFrame, cfg: IntervalConfig) -> DataFrame:
    """One row per segment with everything that its features need: the gate's columns and `itv`, the intervals of its notes in
    order (empty where it isn't pitched), with what follows from them. A segment is bounded by cfg.segment_length, so its
    notes fit one array, and no window, join or second look at the frames is needed."""
    voiced, zero = F.col("voiced").cast("int"), F.lit(0)
    h, p = F.sqrt(F.avg("h_power")) + num(1e-12), F.sqrt(F.avg("p_power")) + num(1e-12)
    note = F.when(F.col("voiced") & (F.col("f0_hz") > 0), F.struct("frame_idx", pitch_class(F.col("f0_hz"), cfg.bins).cast("int").alias("pc")))
    rows = frames.groupBy(*G).agg(
        F.avg(voiced).alias("voiced_ratio"), F.sum(voiced).alias("n_voiced"), F.count(F.lit(1)).alias("n_frames"), (h / (h + p + num(EPS))).alias("harmonic_ratio"),
        F.array_sort(F.collect_list(note)).alias("_notes"),
    )
    poor = (F.col("voiced_ratio") < cfg.min_voiced_ratio) | (F.col("n_voiced") < cfg.min_voiced) | (F.col("harmonic_ratio") < cfg.min_harmonic_ratio) | (F.size("_notes") < cfg.min_voiced)
    rows = rows.withColumn("pitched", ~poor).withColumn("_pc", F.when(F.col("pitched"), F.col("_notes.pc")).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("_n", F.size("_pc")).withColumn("_tail", F.greatest(F.lit(1), F.ceil(F.col("_n") * num(cfg.cadence)).cast("int")))
    rows = rows.withColumn("_last", F.slice("_pc", F.greatest(F.lit(1), F.col("_n") - F.col("_tail") + 1), F.col("_tail")))
    times = lambda column, v: F.size(F.filter(column, lambda x: x == v))
    score = lambda v: F.struct((times("_pc", v) + num(0.5) * times("_last", v)).alias("score"), (-v).alias("low"))
    rows = rows.withColumn("_s", F.sort_array(F.transform(F.array_distinct("_pc"), score), asc=False))
    top, second = F.get("_s", zero)["score"], F.coalesce(F.get("_s", F.lit(1))["score"], num(0))
    rows = rows.withColumn("_tonic", -F.get("_s", zero)["low"]).withColumn("tonic_strength", F.coalesce((top - second) / (top + num(EPS)), num(0)))
    above = lambda x: F.pmod(x - F.col("_tonic"), F.lit(cfg.bins))
    rows = rows.withColumn("itv", F.transform("_pc", above)).withColumn("_end", F.transform("_last", above))
    before, after = F.slice("itv", F.lit(1), F.greatest(zero, F.col("_n") - 1)), F.slice("itv", F.lit(2), F.greatest(zero, F.col("_n") - 1))
    rows = rows.withColumn("_moves", F.arrays_zip(before.alias("a"), after.alias("b")))
    half = cfg.bins // 2
    wrapped = F.transform("_moves", lambda m: F.greatest(F.least(F.pmod(m["b"] - m["a"] + half, F.lit(cfg.bins)) - half, F.lit(cfg.step_clip)), F.lit(-cfg.step_clip)))
    rows = rows.withColumn("_steps", F.when(F.col("_n") == 1, F.array(zero)).otherwise(wrapped))
    # A run ends where the next interval differs; its length is the way from the end before.
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_n"))), lambda i: (F.col("_n") > 0) & ((i == F.col("_n")) | (F.get("itv", i - 1) != F.get("itv", i))))
    rows = rows.withColumn("_ends", ends)
    return rows.withColumn("_runs", F.transform("_ends", lambda e, i: e - F.when(i == 0, zero).otherwise(F.get("_ends", i - 1))))


def _run_buckets(n_bins: int) -> Column:
    """The duration bucket of each run of a packed segment: fixed edges for 8 buckets, else inner quantiles of its runs."""
    if n_bins == 8:
        edges = F.array(*[F.lit(float(x)) for x in DURATION_EDGES])
    else:
        ordered, last = F.sort_array("_runs"), F.size("_runs") - 1

        def quantile(q: float) -> Column:
            at = last * num(q)
            low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
            return F.when(low == high, low.cast("double")).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

        edges = F.array(*[quantile(k / (n_bins - 2)) for k in range(1, n_bins - 2)]) if n_bins > 3 else F.array().cast("array<double>")
    return let(edges, lambda all_edges: F.transform("_runs", lambda length: F.size(F.filter(all_edges, lambda e: e < length))))


def entry_counts(rows: DataFrame, column: str | Column, *names: str) -> DataFrame:
    """A histogram of packed segments, sparse: names (one, or the fields of the array's structs), n, value (the share of the array)."""
    entries = F.col(column) if isinstance(column, str) else column
    each = rows.select(*G, F.size(entries).alias("_whole"), F.explode(entries).alias("_e"))
    each = each.select(*G, "_whole", *([F.col("_e").alias(names[0])] if len(names) == 1 else [F.col(f"_e.{f}").alias(c) for f, c in zip("ab", names, strict=True)]))
    counted = each.groupBy(*G, *names).agg(F.count(F.lit(1)).alias("n"), F.max("_whole").alias("_whole"))
    return counted.select(*G, *names, "n", (F.col("n") / (F.col("_whole") + num(EPS))).alias("value"))


def duration_buckets(n_bins: int) -> Column:
    """The duration bucket of each run of a packed segment."""
    return _run_buckets(n_bins)


def segment_features(frames: DataFrame, cfg: IntervalConfig) -> DataFrame:
    """track_id, seg_idx, pitched, feature, idx, value. Every note, move, step and run is an entry of weight 1 over its
    histogram's total, every scalar one over 1; they are summed where the segment already lies, without a shuffle."""
    rows = packed(frames, cfg).withColumn("_buckets", _run_buckets(cfg.duration_bins))
    entry = lambda name, idx, weight, whole: F.struct(F.lit(name).alias("feature"), idx.cast("int").alias("idx"), weight.alias("weight"), whole.alias("whole"))
    counted = lambda name, column, idx: F.transform(column, lambda x: entry(name, idx(x), num(1), F.size(column) + num(EPS)))
    clip, zero = num(cfg.step_clip), lambda c: F.coalesce(c, num(0))
    steps = F.size("_steps")
    mean = total(F.transform("_steps", lambda x: x.cast("double"))) / steps
    spread = let(mean, lambda m: F.sqrt(total(F.transform("_steps", lambda x: (x - m) * (x - m))) / steps))
    rows = rows.withColumn("step_mean", zero(F.when(steps > 0, total(F.transform("_steps", lambda x: F.abs(x).cast("double"))) / steps / clip)))
    rows = rows.withColumn("step_std", zero(F.when(steps > 0, spread / clip))).withColumn("note_density", F.col("_n") / F.col("n_frames"))
    rows = rows.withColumn("cadence_to_tonic", F.size(F.filter("_end", lambda x: x == 0)) / (F.size("_end") + num(EPS))).withColumn("is_pitched", F.col("pitched").cast("double"))
    same = lambda x: x
    entries = F.concat(
        counted("hist", "itv", same), counted("trans", "_moves", lambda m: m["a"] * cfg.bins + m["b"]), counted("cadence", "_end", same),
        counted("step", "_steps", lambda x: x + cfg.step_clip), counted("duration", "_buckets", same),
        F.array(*[entry("scalar", F.lit(i), F.col(c), num(1)) for i, c in enumerate(SCALARS)]),
    )
    each = rows.select(*G, "pitched", F.explode(entries).alias("e")).select(*G, "pitched", "e.*")
    return each.groupBy(*G, "pitched", "feature", "idx").agg((F.sum("weight") / F.max("whole")).alias("value"))


def profile(frames: DataFrame, cfg: IntervalConfig) -> DataFrame:
    """All features of all segments, sparse: track_id, seg_idx, feature, idx, value. frames: with seg_idx and voiced."""
    return segment_features(frames, cfg).drop("pitched")


def offsets(cfg: IntervalConfig) -> dict[str, int]:
    """Where each feature begins in the vector."""
    sizes = {"hist": cfg.bins, "trans": cfg.bins**2, "cadence": cfg.bins, "step": 2 * cfg.step_clip + 1, "duration": cfg.duration_bins, "scalar": 8}
    out, at = {}, 0
    for name, size in sizes.items():
        out[name] = at
        at += size
    assert at == cfg.segment_size
    return out


def dense(sparse: DataFrame, size: int, place: Column, keys: list[str], zeros: bool = False) -> DataFrame:
    """keys, features: an array of `size` values, zeros where there is none. zeros: keys with nothing but zeros have a row as well."""
    filled = (sparse if zeros else sparse.where(F.col("value") != 0)).withColumn("_at", place.cast("int"))
    entry = F.when(F.col("value") != 0, F.struct("_at", "value"))
    held = filled.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_m"))
    after = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_m", i - 1)["_at"] + 1)
    parts = F.flatten(F.transform("_m", lambda e, i: F.concat(F.array_repeat(num(0), e["_at"] - after(i)), F.array(e["value"]))))
    return held.select(*keys, F.concat(parts, F.array_repeat(num(0), F.lit(size) - after(F.size("_m")))).alias("features"))


def place(cfg: IntervalConfig) -> Column:
    at = F.lit(0)
    for name, start in offsets(cfg).items():
        at = F.when(F.col("feature") == name, F.lit(start)).otherwise(at)
    return at + F.col("idx")


def pool(features: DataFrame) -> DataFrame:
    """segment_features to series, sparse: the mean over pitched segments, or over all if none is pitched; then, as `track`, the
    valid share and the mean voiced and harmonic ratios. Features that a segment lacks are zeros there. One shuffle, by series."""
    scalar = lambda i: F.max(F.when((F.col("feature") == "scalar") & (F.col("idx") == i), F.col("value")))
    segments = features.groupBy(*G, "pitched").agg(F.collect_list(F.struct("feature", "idx", "value")).alias("_e"), scalar(0).alias("_voiced"), scalar(1).alias("_harmonic"))
    tracks = segments.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("_all"), F.sum(F.col("pitched").cast("int")).alias("_good"), F.avg(F.col("pitched").cast("double")).alias("_valid"),
        F.avg("_voiced").alias("_voiced"), F.avg(F.coalesce("_harmonic", num(0))).alias("_harmonic"), F.collect_list(F.struct("pitched", "_e")).alias("_segments"),
    )
    used = F.flatten(F.transform(F.filter("_segments", lambda g: g["pitched"] | (F.col("_good") == 0)), lambda g: g["_e"]))
    whole = F.when(F.col("_good") > 0, F.col("_good")).otherwise(F.col("_all"))
    entry = lambda feature, idx, value, n: F.struct(feature.alias("feature"), idx.alias("idx"), value.alias("value"), n.cast("long").alias("n"))
    own = F.array(*[entry(F.lit("track"), F.lit(i), F.col(c), F.lit(1)) for i, c in enumerate(("_valid", "_voiced", "_harmonic"))])
    entries = F.concat(F.transform(used, lambda e: entry(e["feature"], e["idx"], e["value"], whole)), own)
    each = tracks.select("track_id", F.explode(entries).alias("e")).select("track_id", "e.*")
    return each.groupBy("track_id", "feature", "idx").agg((F.sum("value") / F.max("n")).alias("value"))


def track_features(frames: DataFrame, tracks: DataFrame | None, cfg: IntervalConfig) -> DataFrame:
    """track_id, features (cfg.track_size values): frames to segments to pooled vectors; a track without frames is all zeros, and so are
    frames without a track. tracks: those asked for; without it, those that have frames, by one pass over them and no join."""
    held = voiced_frames(series.cut_evenly(frames, cfg.segment_length, cfg.segments), cfg)
    pooled = pool(segment_features(held, cfg))
    at = F.when(F.col("feature") == "track", F.lit(cfg.segment_size) + F.col("idx")).otherwise(place(cfg))
    vectors = dense(pooled, cfg.track_size, at, ["track_id"], zeros=tracks is None)
    if tracks is None:
        vectors = vectors.withColumn("features", F.when(F.col("track_id").isNotNull(), F.col("features")))
    else:
        vectors = tracks.select("track_id").join(vectors, "track_id", "left")
    return vectors.select("track_id", F.coalesce("features", F.array_repeat(num(0), cfg.track_size)).alias("features"), F.lit(cfg.signature()).alias("cfg_sig"))


def mode_features(frames: DataFrame, cfg: ModeConfig) -> DataFrame:
    """The absolute variant, sparse: pitch, interval and cadence histograms (cadence by absolute class) and four scalars.

    As `packed`: a segment's notes are one array, and everything comes from it; one shuffle by segment, one by histogram entry."""
    voiced, zero, bins = F.col("voiced"), F.lit(0), F.lit(cfg.bins)
    note = F.when(voiced & (F.col("f0_hz") > 0), F.struct("frame_idx", pitch_class(F.col("f0_hz"), cfg.bins).cast("int").alias("pc"), F.col("f0_hz").alias("hz")))
    marked = frames.withColumn("voiced", is_number(F.col("f0_hz")) & F.coalesce("voiced_flag", F.lit(False)))
    rows = marked.groupBy(*G).agg(F.avg(voiced.cast("int")).alias("voiced_ratio"), F.sum(voiced.cast("int")).alias("_v"), F.array_sort(F.collect_list(note)).alias("_notes"))
    rows = rows.withColumn("_notes", F.when(F.col("_v") >= cfg.min_voiced, F.col("_notes")).otherwise(F.slice("_notes", F.lit(1), zero)))
    rows = rows.withColumn("_pc", F.col("_notes.pc")).withColumn("_n", F.size("_notes")).withColumn("_hz", F.array_sort("_notes.hz"))
    tail = F.greatest(F.lit(1), F.ceil(F.col("_n") * num(cfg.cadence)).cast("int"))
    rows = rows.withColumn("_last", F.slice("_pc", F.greatest(F.lit(1), F.col("_n") - tail + 1), tail))
    times = lambda column, v: F.size(F.filter(column, lambda x: x == v))
    rows = rows.withColumn("_s", F.sort_array(F.transform(F.array_distinct("_pc"), lambda v: F.struct(times("_pc", v).alias("n"), (-v).alias("low"))), asc=False))
    share_of = lambda i: F.coalesce(F.get("_s", F.lit(i))["n"] / (F.col("_n") + num(EPS)), num(0))
    rows = rows.withColumn("_tonic", -F.get("_s", zero)["low"]).withColumn("tonic_strength", share_of(0) - share_of(1))
    rows = rows.withColumn("cadence_to_tonic", F.coalesce(times("_last", F.col("_tonic")) / (F.size("_last") + num(EPS)), num(0)))
    middle = (F.get("_hz", F.floor((F.col("_n") - 1) / 2).cast("int")) + F.get("_hz", F.floor(F.col("_n") / 2).cast("int"))) / 2
    rows = rows.withColumn("_mid", F.greatest(middle, num(1e-9)))
    rows = rows.withColumn("_cents", F.transform("_hz", lambda hz: num(1200) * F.log2(F.greatest(hz, num(1e-9)) / F.col("_mid"))))
    count = F.greatest(F.col("_n"), F.lit(1))
    spread = let(total(F.col("_cents")) / count, lambda mean: F.sqrt(total(F.transform("_cents", lambda x: (x - mean) * (x - mean))) / count))
    rows = rows.withColumn("f0_std_cents", F.coalesce(spread, num(0)))
    entry = lambda name, idx, weight, whole: F.struct(F.lit(name).alias("feature"), idx.cast("int").alias("idx"), weight.alias("weight"), whole.alias("whole"))
    counted = lambda name, column, idx: F.transform(column, lambda x: entry(name, idx(x), num(1), F.size(column) + num(EPS)))
    listed = [F.coalesce(c, num(0)) for c in ("voiced_ratio", "tonic_strength", "f0_std_cents", "cadence_to_tonic")]
    entries = F.concat(
        counted("pitch", "_pc", lambda x: x), counted("interval", "_pc", lambda x: F.pmod(x - F.col("_tonic"), bins)), counted("cadence", "_last", lambda x: x),
        F.array(*[entry("scalar", F.lit(i), c, num(1)) for i, c in enumerate(listed)]),
    )
    each = rows.select(*G, F.explode(entries).alias("e")).select(*G, "e.*")
    return each.groupBy(*G, "feature", "idx").agg((F.sum("weight") / F.max("whole")).alias("value"))
