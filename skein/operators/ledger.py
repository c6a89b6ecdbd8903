"""Per-file jobs: names without clashes, what is up to date, what ran and how it ended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import base_name, extension

STATUSES = ("converted", "skipped", "failed")


def output_names(files: DataFrame, folder: str = "dir", name: str = "name", kind: str = "wav") -> DataFrame:
    """Adds out: base.wav for the first of a base name in a folder (whatever its case), base__ext__digest.wav for the others."""
    base = base_name(F.col(name))
    first = F.row_number().over(W.partitionBy(folder, F.lower(base)).orderBy(name)) == 1
    other = F.concat(base, F.lit("__"), extension(F.col(name)), F.lit("__"), F.substring(F.md5(name), 1, 6))
    return files.withColumn("out", F.concat(F.when(first, base).otherwise(other), F.lit(f".{kind}")))


def up_to_date(overwrite: bool = False) -> Column:
    """Of jobs with src_mtime, dst_mtime, dst_size (null where there is no such file)."""
    there = F.col("dst_mtime").isNotNull() & (F.col("dst_mtime") >= F.col("src_mtime")) & (F.col("dst_size") > 0)
    return F.lit(not overwrite) & F.coalesce(there, F.lit(False))


def run_jobs(jobs: DataFrame, action: Callable[[str, str], None], on_error: str = "capture", overwrite: bool = False) -> DataFrame:
    """src, status, details. The action gets (src, dst) of each stale job; an error is captured, or ends the job with the path."""
    if on_error not in ("capture", "fail"):
        raise ValueError(f"on_error: {on_error}")
    marked = jobs.select("src", "dst", up_to_date(overwrite).alias("_skip"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for src, dst, skip in part.itertuples(index=False):
                status, details = "skipped", ""
                if not skip:
                    try:
                        action(src, dst)
                        status = "converted"
                    except Exception as e:
                        if on_error == "fail":
                            raise RuntimeError(f"{src}: {e}") from e
                        status, details = "failed", str(e)
                out.append((src, status, details))
            yield pd.DataFrame(out, columns=["src", "status", "details"])

    return marked.mapInPandas(run, "src string, status string, details string")


def status_counts(ledger: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """status, n; with zeros for those that don't occur."""
    every = ledger.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counts = ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(every).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def failed(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'failed'").select("src", "details")
