"""Segments, windows and runs of ordered series. Every window is partitioned by the series (and segment)."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import draw, num

G = ("track_id", "seg_idx")


#: Rows of a task where series are dealt out anew. A row grows to some kilobytes in the sorts and aggregates of what follows.
TASK_ROWS = 100_000


def deal(df: DataFrame, key: str, rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """df by series, about `rows` rows (TASK_ROWS, if not given) a task, at least a task a core. The number of tasks follows the number of rows, so a
    task's memory doesn't; it is kept by adaptive execution, which goes by bytes as they are shuffled, compressed and before they are
    exploded. Windows, aggregates and joins whose keys hold the series need no other exchange, up to the next Python function.

    counted: the table at rest whose rows are meant, where df is made of it; else df is."""
    tasks = -(-(df if counted is None else counted).count() // (rows or TASK_ROWS))
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), key)


def lengths(frames: DataFrame, key: str = "track_id") -> DataFrame:
    return frames.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _evenly(n: Column, length: int, segments: int) -> Column:
    last = n - length
    if segments <= 1:
        return F.array(F.when(last <= 0, F.lit(0)).otherwise(F.floor(last / 2)).cast("long"))
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.when(i == segments - 1, last).otherwise(F.floor(i * (last.cast("double") / num(segments - 1)))).cast("long")
    )
    return F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(spaced)


def even_starts(lens: DataFrame, length: int, segments: int) -> DataFrame:
    """lens(track_id, n) -> track_id, seg_idx, start: evenly spaced; one at 0 if too short, one in the middle if only one is asked for."""
    return lens.select("*", F.posexplode(_evenly(F.col("n"), length, segments)).alias("seg_idx", "start"))


def random_starts(lens: DataFrame, length: int, segments: int, path: Column, seed: int = 42) -> DataFrame:
    """As even_starts, at places drawn from the path and the seed."""
    last = F.col("n") - length
    drawn = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: draw(last + 1, path, F.lit(seed), i))
    starts = F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(drawn)
    return lens.select("*", F.posexplode(starts).alias("seg_idx", "start"))


def cut(frames: DataFrame, starts: DataFrame, length: int, key: str = "track_id") -> DataFrame:
    """Frames of each segment; a frame is repeated for every segment that holds it. The starts of a series travel to it as one array."""
    listed = starts.groupBy(key).agg(F.collect_list(F.struct("seg_idx", "start")).alias("_s"))
    held = frames.join(listed, key).withColumn("_s", F.explode(F.filter("_s", lambda s: (F.col("frame_idx") >= s["start"]) & (F.col("frame_idx") < s["start"] + length))))
    return held.select(*frames.columns, F.col("_s.seg_idx").alias("seg_idx"))


def cut_evenly(frames: DataFrame, length: int, segments: int, key: str = "track_id") -> DataFrame:
    """As cut at even_starts, in one pass: a series is counted where its frames lie, so no second scan and no join is needed. Frames without a
    key count as one series."""
    starts = F.transform(_evenly(F.col("_n"), length, segments), lambda start, i: F.struct(i.alias("seg_idx"), start.alias("start")))
    counted = frames.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key)))
    held = counted.withColumn("_s", F.explode(F.filter(starts, lambda s: (F.col("frame_idx") >= s["start"]) & (F.col("frame_idx") < s["start"] + length))))
    return held.select(*frames.columns, F.col("_s.seg_idx").alias("seg_idx"))


def run_lengths(df: DataFrame, value: str, by: tuple[str, ...] = G, order: str = "frame_idx") -> DataFrame:
    """Adds _run (which run of equal consecutive values) and _length."""
    ordered = W.partitionBy(*by).orderBy(order)
    ends = df.withColumn("_run", (~F.col(value).eqNullSafe(F.lag(value).over(ordered))).cast("int"))
    runs = ends.withColumn("_run", F.sum("_run").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return runs.withColumn("_length", F.count(F.lit(1)).over(W.partitionBy(*by, "_run")))


def suppress_short_runs(df: DataFrame, mask: str, out: str, min_length: int, by: tuple[str, ...] = G, order: str = "frame_idx") -> DataFrame:
    """out: the mask without its true runs shorter than min_length."""
    if min_length <= 1:
        return df.withColumn(out, F.col(mask))
    return run_lengths(df, mask, by, order).withColumn(out, F.col(mask) & (F.col("_length") >= min_length)).drop("_run", "_length")


def in_tail(share: float, by: tuple[str, ...] = G, order: str = "frame_idx") -> Column:
    """Whether a row is among the last share of its series, one at least."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    return F.row_number().over(W.partitionBy(*by).orderBy(F.col(order).desc())) <= F.greatest(F.lit(1), F.ceil(n * num(share)))


def sliding_median(values: list[float | None], half: int) -> list[float | None]:
    """The median of each value and its `half` neighbours on either side. One ordered list moves along: a value enters, a value leaves,
    so a wider window costs hardly more. Nulls don't count; a window of nulls has none."""
    window: list[float] = []
    out: list[float | None] = []
    for v in values[:half]:
        if v is not None:
            insort(window, v)
    for i in range(len(values)):
        if i + half < len(values) and (new := values[i + half]) is not None:
            insort(window, new)
        if i > half and (old := values[i - half - 1]) is not None:
            del window[bisect_left(window, old)]
        n = len(window)
        out.append((window[(n - 1) // 2] + window[n // 2]) / 2 if n else None)
    return out


def moving_median(df: DataFrame, value: str, out: str, half: int, by: list[str], order: str) -> DataFrame:
    """df with out: the median of value over 2 * half + 1 rows of its series. NaN counts as null.

    A series is one array (as its window was one partition), with its other columns beside it."""

    @F.pandas_udf("array<double>")
    def medians(x: pd.Series) -> pd.Series:
        return pd.Series([sliding_median([None if v is None or v != v else v for v in np.asarray(one, object).tolist()], half) for one in x], dtype=object)

    others = [c for c in df.columns if c not in by]
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *others))).alias("_s"))
    rows = rows.select(*by, F.explode(F.arrays_zip("_s", medians(F.transform("_s", lambda s: s[value].cast("double"))).alias("_m"))).alias("_z"))
    return rows.select(*by, *[F.col("_z._s").getField(c).alias(c) for c in others], F.col("_z._m").alias(out)).select(*df.columns, out)


def slope(value: str, half: int, by: list[str], order: str) -> Column:
    """The least-squares slope over 2 * half + 1 rows; null where a neighbour is missing."""
    w = W.partitionBy(*by).orderBy(order)
    parts = [num(k) * (F.lead(value, k).over(w) - F.lag(value, k).over(w)) for k in range(1, half + 1)]
    return sum(parts[1:], parts[0]) / num(2 * sum(k * k for k in range(1, half + 1)))
