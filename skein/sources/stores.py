"""Tables at rest: manifests, splits, features by content key, runs, models, predictions and reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import stored

MANIFEST = "track_id long, path string, label string"
_SCORES = "struct<acc: double, macro_f1: double, balanced_acc: double>"
RUN = f"model_type string, val {_SCORES}, test {_SCORES}, val_acc double, val_macro_f1 double, val_balanced_acc double, test_acc double, test_macro_f1 double, test_balanced_acc double"


def write_manifest(tracks: DataFrame, path: str, as_json: bool = False) -> None:
    rows = tracks.select("track_id", "path", "label")
    (rows.coalesce(1).write.mode("overwrite").json(path) if as_json else rows.write.mode("overwrite").parquet(path))


def read_manifest(spark: SparkSession, path: str, as_json: bool = False) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path) if as_json else spark.read.parquet(path)


def splits_map(splits: DataFrame) -> DataFrame:
    """The splits as JSON lines of split, bucket and sorted ids: a bucket is a range of 8192 ids, so no list grows with the table."""
    lists = splits.groupBy("split", F.shiftright(F.col("track_id").cast("long"), 13).alias("bucket")).agg(F.sort_array(F.collect_list("track_id")).alias("ids"))
    return lists.select(F.to_json(F.struct("split", "bucket", "ids")).alias("splits"))


def splits_rows(maps: DataFrame, column: str = "splits") -> DataFrame:
    """The reverse: split, track_id."""
    parsed = F.from_json(column, "split string, bucket bigint, ids array<bigint>")
    return maps.select(parsed.alias("_p")).select("_p.split", F.explode("_p.ids").alias("track_id"))


class FeatureStore:
    """Features by content key; only what is missing is computed.

    A job writes its rows to a folder of its own, parted by the first hex digits of the key's md5 and ordered by key, so a lookup only opens the
    parts (and the row groups) that its keys can be in. They count once the job is in the log, whose latest version lists all jobs; a job
    that fails half-way leaves nothing that is read, one that is run again replaces its folder or, if it is in the log, does nothing.
    A version is written only if nobody wrote it before; who comes second looks again at what is stored, so no key is stored twice."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "cache_key", digits: int = 2):
        self.spark, self.path, self.schema, self.key, self.digits = spark, path, schema, key, digits

    def _part(self) -> Column:
        return F.substring(F.md5(F.col(self.key).cast("string")), 1, self.digits)

    def jobs(self) -> tuple[int, list[str]]:
        """The log's latest version and the jobs that count."""
        try:
            rows = self.spark.read.schema("version long, jobs array<string>").json(f"{self.path}/log/*").orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException as e:  # an empty store has no log yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0, []
        return (rows[0]["version"], rows[0]["jobs"]) if rows else (0, [])

    def _log(self, version: int, jobs: list[str]) -> bool:
        """Whether this version could be written."""
        try:
            self.spark.createDataFrame([(version, jobs)], "version long, jobs array<string>").coalesce(1).write.mode("errorifexists").json(f"{self.path}/log/v{version:08d}")
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            return False
        return True

    def _of(self, jobs: list[str], wanted: DataFrame | None = None) -> DataFrame:
        if not jobs:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(f"{self.schema}, _job string, _part string").option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/_job={job}" for job in jobs])
        if wanted is not None:  # 16 ** digits parts at most
            found = found.where(F.col("_part").isin([r["p"] for r in wanted.select(self._part().alias("p")).distinct().collect()]))
        return found.drop("_job", "_part")

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """All that is stored, or the parts that hold the keys of wanted."""
        return self._of(self.jobs()[1], wanted)

    def _write(self, rows: DataFrame, job: str) -> None:
        parted = rows.dropDuplicates([self.key]).withColumn("_part", self._part())
        parted.repartitionByRange("_part", self.key).sortWithinPartitions("_part", self.key).write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/data/_job={job}")

    def put(self, rows: DataFrame, job: str) -> None:
        """Stores the rows whose keys aren't there yet, as one job. Rows of one key count once."""
        while True:
            version, jobs = self.jobs()
            if job in jobs:
                return
            self._write(rows.join(self._of(jobs).select(self.key), self.key, "left_anti"), job)
            if self._log(version + 1, [*jobs, job]):
                return

    def compact(self) -> None:
        """One job in place of all: fewer and larger files. The old folders are left to whoever may still read them."""
        while True:
            version, jobs = self.jobs()
            self._write(self._of(jobs), f"compact-{version}")
            if self._log(version + 1, [f"compact-{version}"]):
                return

    def get(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str | None = None) -> DataFrame:
        """Features of wanted (with its key column); misses are computed and stored first, by a job named after their keys."""
        if key and key != self.key:
            raise ValueError(f"this store's key is {self.key}, not {key}")
        _, missing = hits_and_misses(wanted, self.read(wanted), self.key)
        n, marks = missing.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(self.key))).first()
        if n:
            self.put(compute(missing), f"{n}-{marks & (2**64 - 1):016x}")
        return self.read(wanted).join(wanted.select(self.key).distinct(), self.key, "left_semi")


def hits_and_misses(wanted: DataFrame, stored: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    keys = stored.select(key)
    return wanted.join(keys, key, "left_semi"), wanted.join(keys, key, "left_anti")


def read_runs(spark: SparkSession, root: str, needed: tuple[str, ...] = ("metrics.json", "model_config.json")) -> DataFrame:
    """One row per run folder that has all needed artefacts; flat and nested metrics give the same columns."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("run"), F.element_at(parts, -1).alias("name")).where(F.col("name").isin(list(needed)))
    whole = named.groupBy("run").agg(F.countDistinct("name").alias("n")).where(F.col("n") == len(needed))
    found = spark.read.schema(RUN).option("multiLine", "true").json(f"{root}/*/metrics.json").select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run"))
    pick = lambda s, m: F.coalesce(f"{s}.{m}", f"{s}_{m}").alias(f"{s}_{m}")
    rows = found.select("run", "model_type", *[pick(s, m) for s in ("val", "test") for m in ("acc", "macro_f1", "balanced_acc")])
    return rows.join(whole.select("run"), "run", "left_semi")


def save_model(model: Model, folder: str, labels: list[str], config: dict, metrics: dict | None = None) -> None:
    """The model, its labels and settings, and what was measured, in one folder."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{folder}/model")
    for name, value in (("config", {"labels": labels, **config}), ("metrics", metrics)):
        if value is not None:
            spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def load_model(spark: SparkSession, folder: str) -> tuple[Model, dict]:
    return stored.load(spark, f"{folder}/model"), json.loads(spark.read.text(f"{folder}/config").first()["value"])


def promote(spark: SparkSession, run: str, target: str) -> None:
    """Copies a finished run into the production folder; a run without a model or settings is refused."""
    try:
        model, config = load_model(spark, run)
    except Exception as e:
        raise FileNotFoundError(f"{run} is not a finished run") from e
    try:
        metrics = json.loads(spark.read.text(f"{run}/metrics").first()["value"])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        metrics = None
    save_model(model, target, config.pop("labels"), config, metrics)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)


def write_evaluation(preds: DataFrame, labels: DataFrame, folder: str) -> None:
    """Of preds(y_true, y_pred): metrics and the confusion matrix over labels(label_idx) as JSON lines, and the report as text."""
    ev.metrics(preds).coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")
    ev.confusion(preds, labels).coalesce(1).write.mode("overwrite").json(f"{folder}/confusion")  # labels squared
    shown = F.format_string("%-14s %9.4f %9.4f %9.4f %9d", "name", "precision", "recall", "f1", "support").alias("value")
    ev.report(preds).coalesce(1).select(shown).write.mode("overwrite").text(f"{folder}/report")


def prediction_lines(predictions: DataFrame) -> DataFrame:
    """name TAB label TAB confidence."""
    return predictions.select(F.format_string("%s\t%s\t%.3f", "name", "label", "confidence").alias("value"))
