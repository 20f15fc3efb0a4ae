"""Running monthly revenue from a landing folder of lead uploads.

A lead reappears in later uploads with a newer state, so a plain streaming sum would count it twice.
Every micro-batch is merged into a keyed table of current leads, whose buckets carry their completed trips
added up by day: a call reads the new files, the buckets that their leads fall into, and the sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from foresail.functions.expr import money, month_of
from foresail.operators.leads import as_of_cutoff, completed_trips
from foresail.operators.series import finish_monthly, roll_up
from foresail.schema import LEAD, LEAD_COLUMNS
from foresail.sources.csv_leads import leads_of_lines
from foresail.streaming.state import KeyedState

_UPLOAD = r".*(\d{8}_\d{6})"
#: Lead columns that the sums are kept by: the segments of a running series.
SEGMENTS = ("destination", "lead_source")


def upload_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """Stream of lines with their file, its block, and the time stamp in the file's path (``..._yyyyMMdd_HHmmss...``).

    A file without a time stamp fails the batch: its rows could not be told newer or older."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stamp = F.regexp_extract("_metadata.file_path", _UPLOAD, 1)
    unnamed = F.raise_error(F.concat(F.lit("no time stamp in the name of "), F.col("_metadata.file_path"))).cast("string")
    return reader.load(landing).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.when(stamp == "", unnamed).otherwise(stamp).alias("uploaded"))


def _daily_trips(leads: DataFrame) -> DataFrame:
    return completed_trips(leads).groupBy("bucket", *SEGMENTS, "trip_date").agg(
        F.sum(money(F.col("trip_price"))).alias("r"), F.count("lead_id").alias("n"))


def lead_state(spark: SparkSession, state: str, buckets: int = 256) -> KeyedState:
    """Current leads by id, the row of the newest upload each, with their daily trips by segment."""
    def newest(rest: list[str]):
        return F.max(F.struct("uploaded", *[c for c in rest if c != "uploaded"]))
    return KeyedState(spark, state, "lead_id", newest, {"trips": _daily_trips}, buckets)


def append_uploads(spark: SparkSession, landing: str, state: str, checkpoint: str, max_files: int | None = None, buckets: int = 256) -> None:
    """Take up every file not seen before, each read by its own header, and stop."""
    current = lead_state(spark, state, buckets)

    def merge(batch: DataFrame, batch_id: int) -> None:
        lines = batch.withColumn("at", F.monotonically_increasing_id())
        try:
            leads = leads_of_lines(lines, ["uploaded"])
        except ValueError as fault:
            if str(fault) != "no data lines":
                raise
            leads = spark.createDataFrame([], LEAD.add("uploaded", "string"))
        current.merge(leads, batch_id)

    query = (upload_stream(spark, landing, max_files).writeStream.foreachBatch(merge)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def current_leads(spark: SparkSession, state: str) -> DataFrame:
    """Newest state of every lead. Rows without an id have no newer state to be replaced by: each stays as it is."""
    rows = lead_state(spark, state).table()
    return spark.createDataFrame([], LEAD) if rows is None else rows.select(*LEAD_COLUMNS)


def current_revenue(spark: SparkSession, state: str, keys: Sequence[str] = (), as_of=None) -> DataFrame:
    """Monthly revenue of the current leads, as ``monthly_revenue`` gives it, from the daily sums."""
    unknown = [k for k in keys if k not in SEGMENTS]
    if unknown:
        raise ValueError(f"no running sums by {unknown}; take monthly_revenue of current_leads")
    days = lead_state(spark, state).table("trips")
    if days is None:
        days = spark.createDataFrame([], "destination string, lead_source string, trip_date date, r decimal(28,2), n long")
    months = as_of_cutoff(days, as_of).groupBy(*keys, month_of(F.col("trip_date")).alias("month")).agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    return finish_monthly(roll_up(months, keys, ["month"], {"r": "r", "n": "n"}))


def stream_monthly_revenue(spark: SparkSession, landing: str, state: str, checkpoint: str,
                           keys: Sequence[str] = (), as_of=None, max_files: int | None = None, buckets: int = 256) -> DataFrame:
    """Bring the lead table up to date, then the monthly revenue of the current leads."""
    append_uploads(spark, landing, state, checkpoint, max_files, buckets)
    return current_revenue(spark, state, keys, as_of)
