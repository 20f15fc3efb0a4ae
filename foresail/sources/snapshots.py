"""Saved forecasts: append, list newest first, delete by id."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = ("id string, name string, created_at timestamp, created_by string, series_id string, "
          "data array<struct<month: date, forecast: double, lower: double, upper: double>>")


class SnapshotStore:
    """One row per snapshot and series in an append-only Parquet folder.

    Deleting appends a tombstone; ``visible`` anti-joins them. Nothing is rewritten in place, so
    readers never see a half-written table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def save(self, forecast: DataFrame, name: str, created_by: str, created_at=None, ident: str | None = None) -> str:
        """Append one snapshot; a series' points (a dozen) become one array."""
        ident = ident or str(uuid.uuid4())
        points = F.array_sort(F.collect_list(F.struct("month", "forecast", "lower", "upper")))
        when = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
        (forecast.groupBy("series_id").agg(points.alias("data"))
         .select(F.lit(ident).alias("id"), F.lit(name).alias("name"), when.alias("created_at"),
                 F.lit(created_by).alias("created_by"), "series_id", "data")
         .write.mode("append").parquet(f"{self.root}/snapshots"))
        return ident

    def delete(self, ident: str, role: str) -> bool:
        """Admins only; anyone else changes nothing."""
        if role != "admin":
            return False
        self.spark.createDataFrame([(ident,)], "id string").write.mode("append").parquet(f"{self.root}/deleted")
        return True

    def visible(self) -> DataFrame:
        deleted = self._read("deleted", "id string").distinct()
        return self._read("snapshots", SCHEMA).join(deleted, "id", "left_anti")

    def newest_first(self) -> DataFrame:
        return self.visible().orderBy(F.desc("created_at"), "id", "series_id")
