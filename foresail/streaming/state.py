"""A keyed table that micro-batches bring up to date, one small part at a time.

Rows are dealt into hash buckets by key. A batch rewrites the buckets that its keys fall into, as a new
version of their files, and then writes the list of every bucket's current version as its last step:
readers follow the newest list, so they see a batch wholly or not at all. A repeated batch starts from the
list before its own and writes the same files again. What depends on the rows of a bucket alone, such as
sums by group, can be kept beside it and is renewed with it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foresail.session import settle


def read_if_there(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The Parquet table at ``paths``; None where nothing was written yet."""
    try:
        return spark.read.parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class KeyedState:
    """Current rows by key under ``root``, with the tables that ``derived`` makes of each bucket's rows.

    ``newest`` orders the rows of a key: the greatest is the current one. ``buckets`` holds for a new
    state; an old one keeps its own. Rows with a null key have no successor and all stay current: a batch
    appends them in a folder of its own."""

    def __init__(self, spark: SparkSession, root: str, key: str, newest: Callable[[list[str]], Column],
                 derived: dict[str, Callable[[DataFrame], DataFrame]] | None = None, buckets: int = 256):
        self.spark, self.root, self.key, self.newest = spark, root.rstrip("/"), key, newest
        self.derived, self.buckets = derived or {}, buckets

    def _lists(self, before: int | None = None) -> tuple[int | None, int, dict[int, int]]:
        """(newest batch, number of buckets, version by bucket) of the newest list, or of that before a batch."""
        lists = read_if_there(self.spark, f"{self.root}/versions")
        if lists is not None and before is not None:
            lists = lists.filter(F.col("batch") < before)
        newest = None if lists is None else lists.agg(F.max("batch")).first()[0]
        if newest is None:
            return None, self.buckets, {}
        rows = lists.filter(F.col("batch") == newest).collect()
        return newest, rows[0].buckets, {r.bucket: r.version for r in rows if r.version is not None}

    def _read(self, table: str, versions: dict[int, int]) -> DataFrame | None:
        """A table's rows of the given buckets; reads no other buckets' files."""
        if not versions:
            return None
        if table == "rows":
            return read_if_there(self.spark, *[f"{self.root}/rows/version={v}/bucket={b}" for b, v in versions.items()])
        # a bucket's rows may give no derived ones: then it has no folder
        rows = self._read("rows", versions)
        schema = self.derived[table](rows.withColumn("bucket", F.lit(0)).limit(0)).schema
        found = [self.spark.read.schema(schema).parquet(f"{self.root}/{table}/version={v}").filter(F.col("bucket").isin([b for b in versions if versions[b] == v]))
                 for v in sorted(set(versions.values()))]
        return reduce(DataFrame.unionByName, found).drop("bucket")

    def _write(self, table: str, rows: DataFrame, batch: int) -> None:
        (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy("bucket").parquet(f"{self.root}/{table}/version={batch}"))

    def merge(self, batch_rows: DataFrame, batch: int) -> None:
        """Take up a batch; its number orders batches and names its files."""
        _, buckets, versions = self._lists(before=batch)
        batch_rows = settle(batch_rows)  # read from its files once, not once per step below
        rest = [c for c in batch_rows.columns if c != self.key]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")
        known = batch_rows.filter(F.col(self.key).isNotNull()).withColumn("bucket", bucket)
        touched = sorted(r.bucket for r in known.select("bucket").distinct().collect())
        if touched:
            old = self._read("rows", {b: versions[b] for b in touched if b in versions})
            if old is not None:
                known = known.unionByName(old.withColumn("bucket", bucket))
            current = known.groupBy("bucket", self.key).agg(self.newest(rest).alias("s")).select("bucket", self.key, *[F.col(f"s.{c}").alias(c) for c in rest])
            self._write("rows", current, batch)
            written = self.spark.read.parquet(f"{self.root}/rows/version={batch}")
            for name, make in self.derived.items():
                self._write(name, make(written), batch)
        keyless = batch_rows.filter(F.col(self.key).isNull()).withColumn("bucket", F.lit(-1))
        keyless.write.mode("overwrite").parquet(f"{self.root}/keyless/batch={batch}")
        for name, make in self.derived.items():
            make(keyless).write.mode("overwrite").parquet(f"{self.root}/{name}-keyless/batch={batch}")
        versions.update(dict.fromkeys(touched, batch))
        listed = self.spark.createDataFrame([(b, v, buckets) for b, v in versions.items()] or [(0, None, buckets)], "bucket int, version long, buckets int")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/versions/batch={batch}")

    def table(self, name: str = "rows") -> DataFrame | None:
        """Current rows, or a derived table's parts by bucket; None before the first batch."""
        newest, _, versions = self._lists()
        if newest is None:
            return None
        parts = self._read(name, versions)
        loose = read_if_there(self.spark, f"{self.root}/{'keyless' if name == 'rows' else f'{name}-keyless'}")
        loose = loose.filter(F.col("batch") <= newest).drop("batch", "bucket")
        return loose if parts is None else parts.unionByName(loose)
