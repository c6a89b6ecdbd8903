"""Manifests, splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import SplitConfig
from ..functions.scalars import num

SPLITS = ("train", "val", "test")


def label_index(label: Column, labels: list[str]) -> Column:
    """Position in the list; null for others."""
    return F.nullif(F.array_position(F.lit(labels), label) - 1, F.lit(-1)).cast("int")


def ranges(rows: DataFrame, order: list[str], parts: int = 256) -> DataFrame:
    """Adds _range: the place of the row's `order` columns among at most parts - 1 bounds, taken from 64 * parts rows drawn by hash."""
    key = rows.select(*order)
    drawn = key.orderBy(F.xxhash64(*order)).limit(64 * parts).orderBy(*order).collect()
    cuts = sorted({len(drawn) * k // parts for k in range(1, parts)} - {0})
    kind = f"bounds array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in key.schema)}>>"
    bounds = rows.sparkSession.createDataFrame([([tuple(drawn[k]) for k in cuts],)], kind)
    own = F.struct(*order)
    return rows.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("bounds", lambda x: x <= own))).drop("bounds")  # a row of bounds


def numbered(files: DataFrame, labels: list[str], name: str = "name") -> DataFrame:
    """Adds track_id: by order of the label, then by name and path. Rows are numbered within ranges of that order and shifted by
    the ranges before, so no task sorts a whole label."""
    placed = ranges(files.withColumn("_label", label_index(F.col("label"), labels)).where("_label IS NOT NULL"), ["_label", name, "path"])
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))  # a row per range
    before = counts.select("_range", (F.sum("_n").over(W.partitionBy("_one").orderBy("_range")) - F.col("_n")).alias("_before"))
    order = W.partitionBy("_range").orderBy("_label", name, "path")
    rows = placed.withColumn("_row", F.row_number().over(order)).join(F.broadcast(before), "_range")
    return rows.select((F.col("_before") + F.col("_row") - 1).cast("long").alias("track_id"), *files.columns)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, label, change: added or removed. Empty if the manifests hold the same rows."""
    a, b = old.select("path", "label").distinct().withColumn("_old", F.lit(True)), new.select("path", "label").distinct().withColumn("_new", F.lit(True))
    joined = a.join(b, ["path", "label"], "full_outer")
    changed = joined.where("_old IS NULL OR _new IS NULL")
    return changed.select("path", "label", F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("change"))


def hash_rank(rows: DataFrame, key: Column, seed: str, by: str = "label") -> DataFrame:
    """Adds _rank, from 1, in the order of md5(seed|key) within `by`. Ranks are counted in 4096 buckets of the hash and shifted
    by the buckets before, so no task sorts a whole label."""
    marked = rows.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))).withColumn("_bucket", F.substring("_hash", 1, 3))
    counts = marked.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(by, "_bucket", (F.sum("_n").over(W.partitionBy(by).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy(by, "_bucket").orderBy("_hash", key))
    placed = marked.withColumn("_within", within).join(before, [by, "_bucket"])
    return placed.withColumn("_rank", F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within", "_hash")


def _largest_remainder(rows: DataFrame, total: Column, share: Column, out: str) -> DataFrame:
    """rows (a row per label): out = floor(share), and one more for the largest remainders until the sum is total."""
    base = rows.withColumn("_total", total).withColumn("_share", share).withColumn("_base", F.floor("_share"))
    left = F.col("_total") - F.sum("_base").over(W.partitionBy("_one"))
    rank = F.row_number().over(W.partitionBy("_one").orderBy((F.col("_base") - F.col("_share")).asc(), F.col("label")))
    return base.withColumn("_left", left).withColumn("_r", rank).withColumn(out, F.col("_base") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).drop("_total", "_share", "_base", "_left", "_r")


def quotas(tracks: DataFrame, cfg: SplitConfig) -> DataFrame:
    """label, _temp, _val: how many tracks of a label leave the train split, and how many of those are val."""
    both = cfg.val + cfg.test
    counts = tracks.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    counts = counts.withColumn("_all", F.sum("_n").over(W.partitionBy("_one")))  # a row per label from here
    temp = F.ceil(F.col("_all") * num(both))
    rows = _largest_remainder(counts, temp, temp * F.col("_n") / F.col("_all").cast("double"), "_temp")
    out = F.sum("_temp").over(W.partitionBy("_one"))
    val = out if cfg.test == 0 else F.floor(out * num(cfg.val / both))
    return _largest_remainder(rows, val, val * F.col("_temp") / out.cast("double"), "_val").select("label", "_temp", "_val")


def stratified_split(tracks: DataFrame, cfg: SplitConfig, key: str = "path") -> DataFrame:
    """track_id, split."""
    ranked = hash_rank(tracks, F.col(key), str(cfg.seed))
    joined = ranked.join(F.broadcast(quotas(tracks, cfg)), "label")  # a row per label
    split = F.when(F.col("_rank") <= F.col("_val"), "val").when(F.col("_rank") <= F.col("_temp"), "test").otherwise("train")
    return joined.select("track_id", split.alias("split"))


def stratified_folds(tracks: DataFrame, k: int = 5, repeats: int = 1, seed: int = 42, key: str = "path") -> DataFrame:
    """repeat, fold, track_id: each track in one fold of each repeat."""
    if k < 2 or repeats < 1:
        raise ValueError("folds need k of 2 or more, and a repeat")
    out = None
    for r in range(repeats):
        one = hash_rank(tracks, F.col(key), str(seed + r)).select(F.lit(r).alias("repeat"), ((F.col("_rank") - 1) % k).cast("int").alias("fold"), "track_id")
        out = one if out is None else out.unionByName(one)
    return out


def validity(splits: DataFrame, tracks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each value of the columns `by`, which splits then has): valid, reason (the first that applies).

    Splits and tracks meet once, by id; what an id shows is counted by id, then in all."""
    known = tracks.groupBy("track_id").agg(F.lit(True).alias("_known"))
    has = [F.max((F.col("split") == name).cast("int")).alias(f"_{name}") for name in SPLITS]
    ids = splits.join(known, "track_id", "left").groupBy(*by, "track_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("_known").alias("_known"), F.sum((~F.coalesce(F.col("split").isin(list(SPLITS)), F.lit(False))).cast("int")).alias("_odd"), *has
    )
    every = known.agg(F.count(F.lit(1)).alias("_tracks"))  # one row
    sums = ids.groupBy(*by).agg(
        F.sum("_odd").alias("_odd"), F.sum((F.col("_rows") > 1).cast("int")).alias("_twice"), F.sum(F.col("_known").isNull().cast("int")).alias("_strangers"),
        F.count("_known").alias("_met"), *[F.max(f"_{name}").alias(f"_{name}") for name in SPLITS],
    ).join(F.broadcast(every))
    all_names = F.lit(True)
    for name in SPLITS:
        all_names &= F.coalesce(F.col(f"_{name}") > 0, F.lit(False))
    reason = (
        F.when((F.col("_odd") > 0) | ~all_names, "split names").when(F.col("_strangers") > 0, "unknown ids")
        .when(F.col("_twice") > 0, "repeated ids").when(F.col("_met") < F.col("_tracks"), "missing ids")
    )
    return sums.select(*by, reason.isNull().alias("valid"), F.coalesce(reason, F.lit("")).alias("reason"))


def pick(tracks: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    return tracks.join(splits.where(F.col("split") == split).select("track_id"), "track_id")


def lifecycle(stored: DataFrame | None, scanned: DataFrame, splits: DataFrame | None, cfg: SplitConfig) -> tuple[DataFrame, DataFrame, bool, bool]:
    """(tracks, splits, manifest rebuilt, splits rebuilt): a changed manifest is replaced, and splits that don't fit it are drawn anew."""
    rebuilt = stored is None or difference(stored, scanned).limit(1).count() > 0
    tracks = scanned if rebuilt else stored
    fresh = rebuilt or splits is None or not validity(splits, tracks).first()["valid"]
    return tracks, stratified_split(tracks, cfg) if fresh else splits, rebuilt, fresh
