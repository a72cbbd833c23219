"""Versioned model store (A9): any fitted model of this package, saved whole and loaded in another session.

    <root>/<name>/data/<id>/...          Spark ML save, or parquet of the model's values
    <root>/<name>/versions/<n>.json      version, kind, data id, training key

A version is published by one atomic rename after all its files are written, so a
reader takes the model before or after, never a half-written one; earlier versions stay
readable by number.  ``training_key`` tells what the model was fitted on (for example
``source_key`` of the tables); ``load`` can ask for it, so a model of other data is not taken
by mistake.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import SparkSession

from tallyspark.ml.anomaly import IsolationForestModel
from tallyspark.ml.budget import BudgetModel
from tallyspark.sources.versions import VersionConflict, VersionFiles

PIPELINE, FOREST, BUDGET = "pipeline", "isolation_forest", "budget"
POINTERS = "version long, kind string, data string, training_key string"


class ModelNotFound(LookupError):
    """No stored version answers the request."""


def _kind(model) -> str:
    for cls, kind in ((PipelineModel, PIPELINE), (IsolationForestModel, FOREST), (BudgetModel, BUDGET)):
        if isinstance(model, cls):
            return kind
    raise TypeError(f"no way to store a {type(model).__name__}")


def _save(spark: SparkSession, model, kind: str, path: str) -> None:
    if kind == PIPELINE:
        model.write().save(path)
    elif kind == FOREST:
        model.save(spark, path)
    else:
        model.kmeans.write().save(f"{path}/kmeans")
        columns = [(i, *row) for i, row in enumerate(zip(model.categories, model.means, model.stds))]
        spark.createDataFrame(columns, "i int, category string, mean double, std double").coalesce(1).write.parquet(f"{path}/columns")
        spark.createDataFrame(list(enumerate(model.meanings)), "i int, meaning string").coalesce(1).write.parquet(f"{path}/meanings")


def _load(spark: SparkSession, kind: str, path: str):
    if kind == PIPELINE:
        return PipelineModel.load(path)
    if kind == FOREST:
        return IsolationForestModel.load(spark, path)
    columns = spark.read.parquet(f"{path}/columns").orderBy("i").collect()
    meanings = spark.read.parquet(f"{path}/meanings").orderBy("i").collect()
    return BudgetModel([r["category"] for r in columns], [r["mean"] for r in columns], [r["std"] for r in columns],
                       KMeansModel.load(f"{path}/kmeans"), [r["meaning"] for r in meanings])


class ModelStore:
    """Models by name below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, name: str) -> VersionFiles:
        return VersionFiles(self.spark, f"{self.root}/{name}")

    def save(self, name: str, model, training_key: str = "") -> int:
        """Store a model as the new current version of ``name``; returns its number."""
        kind, data, files = _kind(model), uuid.uuid4().hex[:16], self._files(name)
        _save(self.spark, model, kind, f"{self.root}/{name}/data/{data}")
        while True:
            number = files.current() + 1
            try:
                files.publish(number, {"version": number, "kind": kind, "data": data, "training_key": training_key})
                return number
            except VersionConflict:     # another writer was first: this model comes after its
                continue

    def versions(self, name: str):
        """(version, kind, data, training_key) of a name."""
        return self._files(name).table(POINTERS)

    def load(self, name: str, version: int | None = None, training_key: str | None = None):
        """The model of a version (default: the newest, or the newest fitted on ``training_key``)."""
        files = self._files(name)
        for number in [version] if version is not None else reversed(files.numbers()):
            if number not in files.numbers():
                break
            found = files.pointer(number)
            if training_key is None or found["training_key"] == training_key:
                return _load(self.spark, found["kind"], f"{self.root}/{name}/data/{found['data']}")
        raise ModelNotFound(f"{name}, version {version}, training key {training_key}")
