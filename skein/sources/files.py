"""File listings as tables, through Spark's binaryFile source; contents are never read for a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as audio.
AUDIO = ("mp3", "wav", "flac", "m4a", "ogg")


def is_kind(path: Column, kinds: tuple[str, ...] = AUDIO) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(kinds) + ")$")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, size of all files below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def labeled_files(spark: SparkSession, root: str, labels: list[str], kinds: tuple[str, ...] = AUDIO) -> DataFrame:
    """path, label, name, mtime, size of root/<label>/*; a label without a folder or a root without files is an error."""
    parts = F.split("path", "/")
    found = listing(spark, root).select("path", F.element_at(parts, -2).alias("label"), F.element_at(parts, -1).alias("name"), "mtime", "size")
    there = {r["label"] for r in found.where(F.col("label").isin(labels)).select("label").distinct().collect()}  # labels at most
    if missing := [x for x in labels if x not in there]:
        raise FileNotFoundError(f"no class folder with files for {missing}")
    out = found.where(F.col("label").isin(labels) & is_kind(F.col("name"), kinds))
    if not out.limit(1).count():
        raise FileNotFoundError(f"no audio files below {root}")
    return out


def inputs(spark: SparkSession, path: str, kinds: tuple[str, ...] = AUDIO) -> DataFrame:
    """A single file or the files of a folder, in order of the path."""
    found = spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return found.where(is_kind(F.col("path"), kinds)).orderBy("path")
