"""Exports of finished series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foresail.sources.csv_records import named_cells, placed_lines


def export_rows(points: DataFrame) -> DataFrame:
    """Display columns: "MMM yyyy", "$1,234", Historical/Forecast, bookings as text."""
    return points.select(
        "series_id", F.col("month"),
        F.date_format("month", "MMM yyyy").alias("Date"),
        F.concat(F.lit("$"), F.format_number(F.round("revenue", 0), 0)).alias("Revenue"),
        F.initcap("type").alias("Type"), F.col("bookings").cast("string").alias("Bookings"))


#: Series that share a file: the number of files follows the series, not one folder each.
SERIES_PER_FILE = 500


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """Rows by series into files of whole series, sorted."""
    series = rows.select("series_id").distinct().count()
    return rows.repartition(1 + series // SERIES_PER_FILE, "series_id").sortWithinPartitions("series_id", *order)


def export_series_csv(points: DataFrame, path: str, with_bookings: bool = True) -> None:
    """CSV files of whole series in month order, every cell quoted; each file begins with its plain header."""
    columns = ["series_id", "Date", "Revenue", "Type"] + (["Bookings"] if with_bookings else [])
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = _dealt(export_rows(points).select("series_id", "month", F.concat_ws(",", *[cell(F.col(c)) for c in columns]).alias("line")), "month")
    # the low bits count the rows of a file
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows.select(F.concat(F.when(first, ",".join(columns) + "\n").otherwise(""), "line").alias("value")).write.text(path)


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """The cells of exported files as text, by each file's header."""
    return named_cells(placed_lines(spark.read.text(path)), ["series_id", "Date", "Revenue", "Type", "Bookings"], ["series_id", "Date", "Revenue", "Type"])


def forecast_json(forecast: DataFrame) -> DataFrame:
    """One JSON record per forecast month."""
    return forecast.select("series_id", "month", F.to_json(F.struct(
        F.date_format("month", "yyyy-MM-dd").alias("date"), "forecast",
        F.coalesce("lower", F.lit(0.0)).alias("lower"), F.coalesce("upper", F.lit(0.0)).alias("upper"))).alias("record"))


def write_forecast_json(forecast: DataFrame, path: str) -> None:
    """JSON records with their series, in files of whole series in month order."""
    (_dealt(forecast.select("series_id", F.date_format("month", "yyyy-MM-dd").alias("date"), "forecast", "lower", "upper"), "date")
     .write.json(path))
