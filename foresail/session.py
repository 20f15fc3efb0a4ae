"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(name: str = "foresail", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder.

    Only a local master (tests, a laptop) may do without one and gets a temporary folder; on a cluster
    the executors would not see it, so there a missing folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foresail-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a small, repeatedly used intermediate to the shared folder and cut its lineage.

    Several branches then read it instead of re-scanning the leads, and a lost executor
    costs a re-read of a file, not of the source."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Settle a lookup table and mark it for broadcast only if it has at most ``rows`` rows and ``size`` bytes of text.

    Larger ones come back unmarked and are joined by shuffle, where adaptive execution splits
    dominant keys."""
    settled = settle(df)
    text = F.octet_length(F.to_json(F.struct("*")))
    seen = settled.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("size")).first()
    return F.broadcast(settled) if seen.n <= rows and seen.size <= size else settled
