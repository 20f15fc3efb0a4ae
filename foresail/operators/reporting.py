"""Analytics over finished series: summaries, growth, classes and chart rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from foresail.functions.expr import as_date, ratio
from foresail.schema import HORIZON


def _p():
    return Window.partitionBy("series_id")


def _w():
    return _p().orderBy("month")


def combined_series(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Historical and forecast months as one set of chart points."""
    past = history.select("series_id", "month", "revenue", F.col("bookings").cast("long").alias("bookings"),
                          F.lit("historical").alias("type"), F.lit(None).cast("double").alias("lower"),
                          F.lit(None).cast("double").alias("upper"))
    ahead = forecast.select("series_id", "month", F.col("forecast").alias("revenue"),
                            F.lit(None).cast("long").alias("bookings"), F.lit("forecast").alias("type"),
                            "lower", "upper")
    return past.unionByName(ahead)


def sorted_points(points: DataFrame) -> DataFrame:
    return points.orderBy("series_id", "month")


def filter_series(points: DataFrame, forecast_only: bool = False, start=None, end=None) -> DataFrame:
    out = points.filter(F.col("type") == "forecast") if forecast_only else points
    if start is not None and end is not None:
        out = out.filter(F.col("month").between(as_date(start), as_date(end)))
    return out


def monthly_bookings(history: DataFrame, monthly: DataFrame) -> DataFrame:
    """History with the number of completed trips of the month; months without any show null."""
    counts = monthly.select("series_id", "month", F.col("trip_count").alias("_n"))
    return (history.join(counts, ["series_id", "month"], "left")
            .withColumn("bookings", F.nullif(F.coalesce("_n", F.lit(0)), F.lit(0))).drop("_n"))


def forecast_summary(forecast: DataFrame) -> DataFrame:
    mean, std = F.avg("forecast"), F.stddev_samp("forecast")
    return forecast.groupBy("series_id").agg(
        F.sum("forecast").alias("total_forecast"), mean.alias("average_monthly"),
        F.min("forecast").alias("min_monthly"), F.max("forecast").alias("max_monthly"),
        std.alias("std_monthly"), F.when(mean > 0, std / mean).otherwise(0.0).alias("coefficient_of_variation"))


def horizon_kpis(points: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Sums of the first 1, 3 and 6 forecast months against the historical monthly mean, and the
    total against a baseline forecast (its own, where no other is given)."""
    ahead = F.col("type") == "forecast"
    # past months come before the forecast, so counting forecast months numbers them
    rn = F.count(F.when(ahead, 1)).over(_w())
    kpis = points.withColumn("_rn", rn).groupBy("series_id").agg(
        F.coalesce(F.sum(F.when(ahead, F.col("revenue"))), F.lit(0.0)).alias("total_forecast"),
        *[F.coalesce(F.sum(F.when(ahead & (F.col("_rn") <= k), F.col("revenue"))), F.lit(0.0))
          .alias(f"forecast_{k}mo") for k in (1, 3, 6)],
        F.coalesce(F.avg(F.when(~ahead, F.col("revenue"))), F.lit(0.0)).alias("historical_mean"))
    if baseline is None:
        kpis = kpis.withColumn("baseline_total", F.col("total_forecast"))
    else:
        totals = baseline.groupBy("series_id").agg(F.sum("forecast").alias("baseline_total"))
        kpis = kpis.join(totals, "series_id", "left").na.fill(0.0, ["baseline_total"])
    mean = F.col("historical_mean")
    return (kpis.withColumn("avg_12mo", F.col("total_forecast") / HORIZON)
            .withColumn("diff", F.col("total_forecast") - F.col("baseline_total"))
            .withColumn("diff_pct", ratio(F.col("diff") * 100, F.col("baseline_total")))
            .withColumns({f"compare_{k}mo": ratio((F.col(f"forecast_{k}mo") / k - mean) * 100, mean)
                          for k in (1, 3, 6)}))


def executive_growth(points: DataFrame) -> DataFrame:
    ahead = F.col("type") == "forecast"
    sums = points.groupBy("series_id").agg(
        F.coalesce(F.sum(F.when(ahead, F.col("revenue"))), F.lit(0.0)).alias("total_forecast"),
        F.coalesce(F.sum(F.when(~ahead, F.col("revenue"))), F.lit(0.0)).alias("total_historical"))
    return (sums.withColumn("average_monthly", F.col("total_forecast") / HORIZON)
            .withColumn("growth_pct", F.try_divide((F.col("total_forecast") - F.col("total_historical")) * 100,
                                                   F.col("total_historical"))))


def forecast_vs_history(points: DataFrame) -> DataFrame:
    """Mean forecast month against mean historical month; only series where both are positive."""
    ahead = F.col("type") == "forecast"
    means = points.groupBy("series_id").agg(
        F.avg(F.when(ahead, F.col("revenue"))).alias("forecast_mean"),
        F.avg(F.when(~ahead, F.col("revenue"))).alias("historical_mean"))
    return (means.filter((F.col("forecast_mean") > 0) & (F.col("historical_mean") > 0))
            .withColumn("growth_pct", (F.col("forecast_mean") / F.col("historical_mean") - 1) * 100))


def quarterly_forecast(forecast: DataFrame) -> DataFrame:
    """Total and average of months 1-3, 4-6, 7-9, 10-12, with the growth from Q1 to Q4."""
    quarters = (forecast.withColumn("_rn", F.row_number().over(_w())).filter(F.col("_rn") <= HORIZON)
                .groupBy("series_id", F.ceil(F.col("_rn") / 3).cast("int").alias("quarter"))
                .agg(F.sum("forecast").alias("total"), F.avg("forecast").alias("average"),
                     F.count(F.lit(1)).alias("_n")))
    q1, q4 = (F.max(F.when((F.col("quarter") == q) & (F.col("_n") == 3), F.col("average"))).over(_p()) for q in (1, 4))
    growth = F.when((F.col("_q1") > 0) & (F.col("_q4") > 0), (F.col("_q4") - F.col("_q1")) / F.col("_q1") * 100)
    return (quarters.withColumn("_q1", q1).withColumn("_q4", q4).withColumn("q1_to_q4_pct", growth)
            .drop("_n", "_q1", "_q4"))


def peak_trough(forecast: DataFrame) -> DataFrame:
    """Month and value of the maximum and the minimum; the earlier month wins ties."""
    high = F.min(F.struct((-F.col("forecast")).alias("v"), "month"))
    low = F.min(F.struct(F.col("forecast").alias("v"), "month"))
    return (forecast.groupBy("series_id").agg(high.alias("h"), low.alias("l"))
            .select("series_id", F.col("h.month").alias("peak_month"), (-F.col("h.v")).alias("peak_value"),
                    F.col("l.month").alias("trough_month"), F.col("l.v").alias("trough_value")))


def trend_class(forecast: DataFrame) -> DataFrame:
    """Last three months against the first three: INCREASING, DECREASING or STABLE (5 %)."""
    n = F.count(F.lit(1)).over(_p())
    rows = forecast.withColumn("_rn", F.row_number().over(_w())).withColumn("_n", n)
    enough = F.col("_n") >= 3
    means = rows.groupBy("series_id").agg(
        F.coalesce(F.avg(F.when(enough & (F.col("_rn") <= 3), F.col("forecast"))), F.lit(0.0)).alias("first_mean"),
        F.coalesce(F.avg(F.when(enough & (F.col("_rn") > F.col("_n") - 3), F.col("forecast"))), F.lit(0.0))
        .alias("last_mean"))
    change = ratio((F.col("last_mean") - F.col("first_mean")) * 100, F.col("first_mean"))
    return means.withColumn("trend_pct", change).withColumn(
        "trend", F.when(F.col("trend_pct") > 5, "INCREASING").when(F.col("trend_pct") < -5, "DECREASING")
        .otherwise("STABLE"))


def volatility_class(forecast: DataFrame) -> DataFrame:
    """Coefficient of variation in percent and its class; needs two months."""
    mean, std = F.avg("forecast"), F.stddev_samp("forecast")
    return (forecast.groupBy("series_id")
            .agg(F.count(F.lit(1)).alias("_n"), F.when(mean > 0, std / mean * 100).otherwise(0.0).alias("cv_pct"))
            .filter("_n > 1").drop("_n")
            .withColumn("volatility", F.when(F.col("cv_pct") > 20, "HIGH").when(F.col("cv_pct") > 10, "MODERATE")
                        .otherwise("LOW")))


def month_over_month(forecast: DataFrame, value: str = "forecast") -> DataFrame:
    """Change against the previous month in percent (0 from nothing; null for the first)."""
    prev = F.lag(value).over(_w())
    return (forecast.withColumn("previous", prev)
            .withColumn("mom_pct", F.when(F.col("previous").isNotNull(),
                                          ratio((F.col(value) - F.col("previous")) * 100, F.col("previous"))))
            .withColumn("mom_label", F.when(F.col("previous").isNull(), " (Baseline)").otherwise(
                F.concat(F.lit(" (MoM: "), F.format_string("%+.1f", "mom_pct"), F.lit("%)")))))


def deviation_from_mean(forecast: DataFrame) -> DataFrame:
    mean = F.col("mean_forecast")
    return (forecast.withColumn("mean_forecast", F.avg("forecast").over(_p()))
            .withColumn("vs_mean", F.when(F.col("forecast") > mean, "ABOVE AVG")
                        .when(F.col("forecast") < mean, "BELOW AVG").otherwise("AT AVG"))
            .withColumn("deviation_pct", ratio((F.col("forecast") - mean) * 100, mean)))


def chart_rows(points: DataFrame) -> DataFrame:
    """Points as a chart needs them: index, previous value, split columns, band and the index of
    the last historical point."""
    past = F.col("type") == "historical"
    bounded = ~past & F.col("lower").isNotNull() & F.col("upper").isNotNull()
    return (points.withColumn("index", F.row_number().over(_w()) - 1)
            .withColumn("prev_revenue", F.lag("revenue").over(_w()))
            .withColumn("revenue_historical", F.when(past, F.col("revenue")))
            .withColumn("revenue_forecast", F.when(~past, F.col("revenue")))
            .withColumn("confidence_band", F.when(bounded, F.array("lower", "upper")))
            .withColumn("half_width", F.when(bounded, (F.col("upper") - F.col("lower")) / 2))
            .withColumn("change_pct", F.when((F.col("prev_revenue") != 0) & (F.col("revenue") != 0),
                                             (F.col("revenue") - F.col("prev_revenue")) / F.col("prev_revenue") * 100))
            .withColumn("date_label", F.date_format("month", "MMM yyyy"))
            .withColumn("transition_index", F.coalesce(F.max(F.when(past, F.col("index"))).over(_p()), F.lit(-1))))


def mask_for_role(response: DataFrame, role: str,
                  columns: Sequence[str] = ("insights", "key_drivers")) -> DataFrame:
    """Empty the sensitive array columns for everyone but admins."""
    if role == "admin":
        return response
    return response.withColumns({c: F.array().cast("array<string>") for c in columns})
