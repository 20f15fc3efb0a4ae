"""Monthly revenue series: aggregation, calendar filling, trimming and profiles.

Raw leads are only ever touched by combined aggregates. Everything after that works on
monthly rows (months x series), partitioned by ``series_id``; all windows here share that
partitioning and an ascending month order, so a whole chain costs one small shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from foresail.functions.expr import money, month_of, months_after, series_labels
from foresail.operators.leads import as_of_cutoff, completed_trips

SERIES = ("series_id",)


def _key(by: Sequence[str]):
    return Window.partitionBy(*by)


def _ordered(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("month")


def from_end(by: Sequence[str] = SERIES) -> Column:
    """1 for the last month of a series, 2 for the one before, ... without a descending sort."""
    return F.count(F.lit(1)).over(_key(by)) - F.row_number().over(_ordered(by)) + 1


def roll_up(by_segment: DataFrame, keys: Sequence[str], by: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Fan an already aggregated segment table out to its series (ALL and own) and add up."""
    return (by_segment.withColumn("series_id", F.explode(series_labels(keys)))
            .groupBy("series_id", *by)
            .agg(*[F.sum(c).alias(name) for name, c in sums.items()]))


def monthly_revenue(leads: DataFrame, keys: Sequence[str] = (), as_of=None) -> DataFrame:
    """Revenue and trips by trip month for ALL and every segment.

    The leads are aggregated once by segment and month (map-side combined, so a dominant
    segment shrinks before the shuffle); ALL is then the sum of those few rows."""
    trips = as_of_cutoff(completed_trips(leads), as_of)
    per_segment = (trips.groupBy(*keys, month_of(F.col("trip_date")).alias("month"))
                   .agg(F.sum(money(F.col("trip_price"))).alias("r"), F.count("lead_id").alias("n")))
    return finish_monthly(roll_up(per_segment, keys, ["month"], {"r": "r", "n": "n"}))


def finish_monthly(rolled: DataFrame) -> DataFrame:
    return rolled.select("series_id", "month",
                         F.coalesce(F.col("r"), F.lit(0)).cast("double").alias("revenue"),
                         F.col("n").alias("trip_count"))


def fill_missing_months(series: DataFrame) -> DataFrame:
    """Insert zero rows for calendar gaps between a series' first and last month.

    Each month is stretched up to the month before its successor, which needs no calendar
    table and no join."""
    until = F.coalesce(months_after(F.lead("month").over(_ordered(SERIES)), -1), F.col("month"))
    stretched = series.withColumn("_until", until).withColumn(
        "at", F.explode(F.sequence("month", "_until", F.expr("interval 1 month"))))
    own = F.col("at") == F.col("month")
    return stretched.select(
        "series_id", F.col("at").alias("month"),
        F.when(own, F.col("revenue")).otherwise(0.0).alias("revenue"),
        F.when(own, F.col("trip_count")).otherwise(0).alias("trip_count"))


def _with_trailing_mean(series: DataFrame, months: int = 6) -> DataFrame:
    """Per row: mean trips and revenue of the series' last ``months`` non-zero months."""
    live = F.col("trip_count") > 0
    # non-zero months from this one to the end of the series
    remaining = F.count(F.when(live, 1)).over(_ordered(SERIES).rowsBetween(0, Window.unboundedFollowing))
    used = live & (F.col("_remaining") <= months)
    return (series.withColumn("_remaining", remaining)
            .select(*series.columns, F.avg(F.when(used, F.col("trip_count"))).over(_key(SERIES)).alias("mean_trips"),
                    F.avg(F.when(used, F.col("revenue"))).over(_key(SERIES)).alias("mean_revenue")))


def trailing_nonzero_mean(series: DataFrame, months: int = 6) -> DataFrame:
    return (_with_trailing_mean(series, months).groupBy("series_id")
            .agg(F.max("mean_trips").alias("mean_trips"), F.max("mean_revenue").alias("mean_revenue")))


def flag_incomplete_months(series: DataFrame, exclude: int = 2) -> DataFrame:
    """Mark recent months that look unfinished (only the last ``exclude`` + 2 are checked)."""
    low = ((F.col("trip_count") < F.col("mean_trips") * 0.5)
           | (F.col("revenue") < F.col("mean_revenue") * 0.3)
           | (F.col("revenue") < 1000))
    checked = (F.col("_n") > exclude) & F.col("mean_trips").isNotNull() & (F.col("rn_desc") <= exclude + 2)
    return (_with_trailing_mean(series)
            .withColumns({"rn_desc": from_end(), "_n": F.count(F.lit(1)).over(_key(SERIES))})
            .select(*series.columns, "rn_desc", F.coalesce(checked & low, F.lit(False)).alias("incomplete")))


def trim_incomplete_tail(flagged: DataFrame) -> DataFrame:
    """Remove the unbroken run of flagged months at the end of each series."""
    last_good = F.min(F.when(~F.col("incomplete"), F.col("rn_desc"))).over(_key(SERIES))
    return (flagged.withColumn("_good", last_good)
            .filter(F.col("rn_desc") >= F.col("_good"))
            .select("series_id", "month", "revenue", "trip_count"))


def drop_collapsed_last_month(series: DataFrame) -> DataFrame:
    """Drop the last month if it is below 20 % of the month before (both positive)."""
    prev = F.lag("revenue").over(_ordered(SERIES))
    return (series.withColumns({"_prev": prev, "_end": from_end()})
            .filter(~F.coalesce((F.col("_end") == 1) & (F.col("revenue") > 0) & (F.col("_prev") > 0)
                                & (F.col("revenue") / F.col("_prev") < 0.2), F.lit(False)))
            .drop("_prev", "_end"))


def trimmed_series(monthly: DataFrame, exclude: int = 2) -> DataFrame:
    """Filled calendar with unfinished recent months removed."""
    return drop_collapsed_last_month(
        trim_incomplete_tail(flag_incomplete_months(fill_missing_months(monthly), exclude)))


def drop_anomalous_last_month(series: DataFrame) -> DataFrame:
    """Drop the last month if far below the mean of the 12 before it, or below 1000."""
    before = F.avg("revenue").over(_ordered(SERIES).rowsBetween(-12, -1))
    low = ((F.col("_before") > 0) & (F.col("revenue") < F.col("_before") * 0.3)) | (F.col("revenue") < 1000)
    return (series.withColumns({"_before": before, "_end": from_end()})
            .filter(~F.coalesce((F.col("_end") == 1) & F.col("_before").isNotNull() & low, F.lit(False)))
            .drop("_before", "_end"))


def last_months(series: DataFrame, k: int) -> DataFrame:
    return series.withColumn("_end", from_end()).filter(F.col("_end") <= k).drop("_end")


def first_months(series: DataFrame, k: int) -> DataFrame:
    return (series.withColumn("_rn", F.row_number().over(_ordered(SERIES)))
            .filter(F.col("_rn") <= k).drop("_rn"))


def series_profile(series: DataFrame) -> DataFrame:
    """One row per series with the history figures the forecast anchors on.

    ``recent_mean_12``/``recent_std_12``/``recent_mean_6`` leave the last month out when it is
    below 30 % of the mean of the other recent months; ``plain_*`` never do."""
    def tail(k, skip_last=False):
        inside = F.col("_end") <= k
        return F.when((inside & (F.col("_end") > 1)) if skip_last else inside, F.col("revenue"))

    stats = (series.withColumn("_end", from_end()).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("months"),
        F.max("month").alias("last_month"),
        F.max(F.when(F.col("_end") == 1, F.col("revenue"))).alias("last_revenue"),
        F.avg("revenue").alias("hist_mean"), F.stddev_samp("revenue").alias("hist_std"),
        F.max("revenue").alias("hist_max"),
        *[F.avg(tail(k)).alias(f"plain_mean_{k}") for k in (6, 12)],
        *[F.avg(tail(k, True)).alias(f"_rest_mean_{k}") for k in (6, 12)],
        F.stddev_samp(tail(12)).alias("_std"), F.stddev_samp(tail(12, True)).alias("_rest_std")))

    def low(k):
        return F.coalesce(F.col("last_revenue") < F.col(f"_rest_mean_{k}") * 0.3, F.lit(False))

    def anchor(k):
        return F.when(low(k), F.col(f"_rest_mean_{k}")).otherwise(F.col(f"plain_mean_{k}"))

    return stats.select(
        "series_id", "months", "last_month", "last_revenue", "hist_mean", "hist_std", "hist_max",
        "plain_mean_6", "plain_mean_12",
        anchor(6).alias("recent_mean_6"), anchor(12).alias("recent_mean_12"),
        F.when(low(12), F.col("_rest_std")).otherwise(F.col("_std")).alias("recent_std_12"))


def growth_columns(series: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Attach to every row whether its series should saturate (``logistic``) and at which ``cap``."""
    n = F.count(F.lit(1)).over(_key(by))
    recent = F.least(F.lit(6), F.col("n"))

    def at(cond):
        return F.max(F.when(cond, F.col("revenue"))).over(_key(by))

    rising = (F.col("_last") - F.col("_first")) / F.col("n")
    now = (F.col("_last") - F.col("_recent_first")) / recent
    cap = F.greatest(F.col("_recent_max") * 1.5, F.col("_max") * 1.2)
    return (series.withColumns({"n": n, "_end": from_end(by), "_max": F.max("revenue").over(_key(by))})
            .withColumns({"_last": at(F.col("_end") == 1), "_first": at(F.col("_end") == F.col("n")),
                          "_recent_first": at(F.col("_end") == recent), "_recent_max": at(F.col("_end") <= recent)})
            .select(*series.columns, "n", (F.col("n") - F.col("_end")).cast("int").alias("t"), cap.alias("cap"),
                    ((F.col("n") >= 3) & (((now <= 0) & (rising > 0)) | (now < rising * 0.5))).alias("logistic")))


def growth_mode(series: DataFrame) -> DataFrame:
    return (growth_columns(series).groupBy("series_id")
            .agg(F.max("n").alias("months"), F.bool_or("logistic").alias("logistic"), F.max("cap").alias("cap"))
            .withColumn("cap", F.when(F.col("logistic"), F.col("cap"))))
