"""Training items from array columns: crops, padding, masks, balanced draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import draw, let, num, total
from .manifest import hash_rank, label_index


def items(tracks: DataFrame, n_train: int, n_eval: int) -> DataFrame:
    """tracks(track_id, split) -> one row per (track, seg_idx)."""
    n = F.when(F.col("split") == "train", n_train).otherwise(n_eval)
    return tracks.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("seg_idx"))


def crop_start(length: Column, size: int, path: Column, seg: Column, train: Column, seed: int = 42) -> Column:
    """Where a crop begins: drawn for training, else in the middle; 0 if the row is too short."""
    spare = length - size
    return F.when(spare <= 0, F.lit(0)).when(train, draw(spare + 1, path, F.lit(seed), seg)).otherwise(F.floor(spare / 2)).cast("long")


def pad_or_cut(values: Column, size: int | Column) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.slice(F.concat(values, F.array_repeat(num(0), size)), F.lit(1), size)


def attach_tracks(segments: DataFrame, tracks: DataFrame, vector: str, own: str, name: Column, labels: list[str]) -> DataFrame:
    """track_id, seg_idx, label_idx, features: each segment's vector followed by its track's; segments without a track go.

    tracks (track_id, the vector `own`, and what `name` needs) is a bank of one row a track; labels outside the list are null."""
    bank = tracks.select("track_id", label_index(name, labels).alias("label_idx"), F.col(own).alias("_own"))
    return segments.join(bank, "track_id").select("track_id", "seg_idx", "label_idx", F.concat(F.col(vector), F.col("_own")).alias("features"))


def crop(values: Column, start: Column, size: int) -> Column:
    return pad_or_cut(F.slice(values, (start + 1).cast("int"), F.lit(size)), size)


def block_mask(values: Column, limit: int, key: Column, seed: int = 42) -> Column:
    """Zeros over a drawn block of at most `limit` values."""
    n = F.size(values)
    width = draw(F.least(n, F.lit(limit)) + 1, key, F.lit(seed), F.lit("width"))
    start = draw(n - width + 1, key, F.lit(seed), F.lit("start"))
    return F.transform(values, lambda v, i: F.when((i >= start) & (i < start + width), num(0)).otherwise(v))


# --- matrices: an array of rows (bins), each an array of values by frame -------------------------------------------


def frames_of(matrix: Column) -> Column:
    return F.coalesce(F.size(F.get(matrix, F.lit(0))), F.lit(0))


def scale_matrix(matrix: Column, eps: float = 1e-6) -> Column:
    """Each value less the mean of all of them, over their population deviation plus eps."""
    flat = F.flatten(matrix)
    n = F.size(flat).cast("double")

    def scaled(mean: Column) -> Column:
        spread = F.sqrt(total(F.transform(flat, lambda x: (x - mean) * (x - mean))) / n)
        return let(spread + num(eps), lambda d: F.transform(matrix, lambda row: F.transform(row, lambda x: (x - mean) / d)))

    return F.when(n > 0, let(total(flat) / n, scaled)).otherwise(matrix)


def crop_frames(matrix: Column, start: Column, size: int) -> Column:
    """The frames from start on, `size` of them; zeros where there are fewer."""
    return F.transform(matrix, lambda row: crop(row, start, size))


def attach_rows(matrix: Column, vector: Column) -> Column:
    """The matrix with a row more for each value of the vector, which holds in all its frames."""
    return F.concat(matrix, F.transform(vector, lambda v: F.array_repeat(v, frames_of(matrix))))


def _block(n: Column, limit: int, key: Column, axis: str, seed: int) -> tuple[Column, Column]:
    """A drawn start, and the end behind it, of at most `limit` of n places."""
    width = draw(F.least(n, F.lit(limit)) + 1, key, F.lit(seed), F.lit(axis), F.lit("width"))
    start = draw(n - width + 1, key, F.lit(seed), F.lit(axis), F.lit("start"))
    return start, start + width


def mask_frames(matrix: Column, limit: int, key: Column, seed: int = 42) -> Column:
    """Zeros over a drawn block of at most `limit` frames, in all rows."""
    start, end = _block(frames_of(matrix), limit, key, "frames", seed)
    ends = F.struct(start.alias("a"), end.alias("b"))
    return let(ends, lambda e: F.transform(matrix, lambda row: F.transform(row, lambda v, i: F.when((i >= e["a"]) & (i < e["b"]), num(0)).otherwise(v))))


def mask_bins(matrix: Column, limit: int, key: Column, seed: int = 42) -> Column:
    """Zeros over a drawn block of at most `limit` rows, in all frames."""
    start, end = _block(F.size(matrix), limit, key, "bins", seed)
    ends = F.struct(start.alias("a"), end.alias("b"))
    return let(ends, lambda e: F.transform(matrix, lambda row, i: F.when((i >= e["a"]) & (i < e["b"]), F.transform(row, lambda v: num(0))).otherwise(row)))


def balanced_sample(rows: DataFrame, key: str, seed: int = 42, label: str = "label") -> DataFrame:
    """As many draws with replacement as rows: draw -> a class by hash (all alike), a row of the class by hash.

    A drawn rank meets the row of that rank by (label, rank): no window over the whole table."""
    ranked = hash_rank(rows.select(F.col(key).alias("_key"), F.col(label).alias("label")), F.col("_key"), str(seed))
    sizes = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("label", "_n"))).alias("_c"))  # one row, an entry per class
    n = rows.count()
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(listed))
    picked = draws.withColumn("_s", F.get("_c", draw(F.size("_c"), F.col("draw"), F.lit(seed), F.lit("class")).cast("int")))
    wanted = picked.select("draw", F.col("_s.label").alias("label"), (draw(F.col("_s._n"), F.col("draw"), F.lit(seed), F.lit("row")) + 1).alias("_rank"))
    return wanted.join(ranked, ["label", "_rank"]).select("draw", "label", F.col("_key").alias(key))
