"""Models that aren't Spark's own, stored and loaded the way Spark stores its own: a metadata file, a folder for each model within
and a Parquet table for each table. They can be stages of a PipelineModel. Nothing is pickled."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession


class Stored(Model, MLWritable, MLReadable):
    """values: numbers, texts and lists of them; parts: models; tables: rows, at rest. A subclass gives _transform."""

    def __init__(self, values: dict[str, Any] | None = None, parts: dict[str, Model] | None = None, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.values, self.parts, self.tables = values or {}, parts or {}, tables or {}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def copy(self, extra=None) -> Stored:
        return self


class _Writer(MLWriter):
    def __init__(self, model: Stored):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802 (Spark's name)
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"values": m.values, "parts": sorted(m.parts), "tables": sorted(m.tables)})
        for name, part in m.parts.items():
            part.write().save(f"{path}/parts/{name}")
        for name, rows in m.tables.items():
            rows.write.parquet(f"{path}/tables/{name}")


class _Reader(MLReader):
    def __init__(self, kind: type[Stored]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Stored:
        spark = self.sparkSession
        known = DefaultParamsReader.loadMetadata(path, spark)
        parts = {name: load(spark, f"{path}/parts/{name}") for name in known["parts"]}
        model = self.kind(known["values"], parts, {name: spark.read.parquet(f"{path}/tables/{name}") for name in known["tables"]})
        model._resetUid(known["uid"])
        return model


def load(spark: SparkSession, path: str) -> Model:
    """The model at path, of whatever class it was."""
    return DefaultParamsReader.loadParamsInstance(path, spark)
