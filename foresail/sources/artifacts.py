"""Store for learned artifacts, all of them Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from foresail.plans.boosting import TREE_SCHEMA, tree_rows, trees_of
from foresail.plans.conversion_model import CATEGORIES, ConversionModel


class ArtifactStore:
    """Named artifacts under one shared folder. Loading a missing artifact returns None.

    Every save writes new files and then, as its last step, one row that names them: a reader sees the
    artifact before or after a save, never between, and files in use are never replaced. Of saves at the
    same time one counts, the same one for all readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, version: str, part: str = "table") -> str:
        return f"{self.root}/{name}/{version}/{part}"

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as error:  # only a missing path means that nothing was saved
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _newest(self, name: str) -> tuple[int, str | None]:
        rows = self._read(f"{self.root}/{name}/versions")
        last = None if rows is None else rows.agg(F.max(F.struct("number", "version")).alias("v")).first().v
        return (0, None) if last is None else (last.number, last.version)

    def _publish(self, name: str, version: str) -> None:
        row = [(self._newest(name)[0] + 1, version)]
        self.spark.createDataFrame(row, "number long, version string").coalesce(1).write.mode("append").parquet(f"{self.root}/{name}/versions")

    def save_table(self, name: str, table: DataFrame) -> None:
        version = uuid.uuid4().hex
        table.write.parquet(self._path(name, version))
        self._publish(name, version)

    def load_table(self, name: str) -> DataFrame | None:
        _, version = self._newest(name)
        return None if version is None else self.spark.read.parquet(self._path(name, version))

    def save_model(self, name: str, model: ConversionModel) -> None:
        """Trees and dictionaries become visible together."""
        version = uuid.uuid4().hex
        trees = self.spark.createDataFrame(tree_rows(model.trees), TREE_SCHEMA).withColumn("depth", F.lit(model.depth))
        trees.coalesce(1).write.parquet(self._path(name, version, "trees"))
        for column in CATEGORIES:
            model.codes[column].write.parquet(self._path(name, version, f"codes_{column}"))
        self._publish(name, version)

    def load_model(self, name: str) -> ConversionModel | None:
        _, version = self._newest(name)
        if version is None:
            return None
        rows = self.spark.read.parquet(self._path(name, version, "trees")).collect()
        codes = {c: self.spark.read.parquet(self._path(name, version, f"codes_{c}")) for c in CATEGORIES}
        return ConversionModel(trees_of(rows), codes, rows[0].depth)
