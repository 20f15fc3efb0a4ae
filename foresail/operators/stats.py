"""Dataset statistics: each is one combined aggregate over the leads or over monthly rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foresail.functions.expr import count_of, money, money_sum, ratio
from foresail.functions.ranks import exact_median
from foresail.operators.leads import completed_trips, open_leads
from foresail.schema import DAYS_PER_YEAR, MIN_HISTORY_YEARS
from foresail.session import settle


def _done() -> Column:
    return F.col("current_stage") == "completed"


def _years(first: Column, last: Column) -> Column:
    return F.datediff(last, first) / DAYS_PER_YEAR


def history_span(leads: DataFrame, min_years: float = MIN_HISTORY_YEARS, by: Sequence[str] = ()) -> DataFrame:
    """First and last completed trip, years between them and whether that is enough history."""
    return (completed_trips(leads).groupBy(*by)
            .agg(F.min("trip_date").alias("first_trip"), F.max("trip_date").alias("last_trip"))
            .withColumn("years", _years(F.col("first_trip"), F.col("last_trip")))
            .withColumn("eligible", F.coalesce(F.col("years") >= min_years, F.lit(False))))


def require_history(leads: DataFrame, min_years: float = MIN_HISTORY_YEARS) -> DataFrame:
    """Strict form: the query fails when there is too little completed history."""
    message = F.concat(F.lit("completed history spans "),
                       F.coalesce(F.format_number("years", 2), F.lit("no")),
                       F.lit(f" years; {min_years} required"))
    return history_span(leads, min_years).withColumn(
        "checked", F.when(F.col("eligible"), True).otherwise(F.raise_error(message).cast("boolean")))


def load_metadata(leads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (leads.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"), count_of(_done()).alias("completed_trips"),
        money_sum(F.when(_done(), F.col("trip_price"))).alias("total_revenue"),
        F.count(F.when(_done(), F.col("trip_price"))).alias("_priced"))
        .withColumn("avg_trip_price", ratio(F.col("total_revenue"), F.col("_priced")))
        .withColumn("conversion_rate", ratio(F.col("completed_trips"), F.col("total_records")))
        .drop("_priced"))


def value_counts(leads: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per known value of a column."""
    return leads.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("leads"))


def completion_rate(leads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (leads.groupBy(*by).agg(count_of(_done()).alias("completed"), F.count(F.lit(1)).alias("total"))
            .withColumn("rate", F.bround(ratio(F.col("completed") * 100, F.col("total")), 2)))


def stage_distribution(leads: DataFrame) -> DataFrame:
    """Leads per stage; the same row set also carries the completion rate in percent."""
    return value_counts(leads, "current_stage")


def revenue_stats(leads: DataFrame, by: Sequence[str] = (), approximate: int | None = None) -> DataFrame:
    """Sum, mean, median, extremes and sample deviation of completed prices.

    The median is exact. With ``approximate`` it comes from a mergeable quantile sketch in the same pass as
    the other figures: a price whose rank is at most 1/``approximate`` of the rows from the middle."""
    done = leads.filter(_done() & F.col("trip_price").isNotNull()).select(*by, "trip_price")
    price = F.col("trip_price")
    if approximate is None:
        done = settle(done)  # the exact median reads the prices twice more
    totals = done.groupBy(*by).agg(
        F.sum(money(price)).cast("double").alias("total_revenue"), F.count(F.lit(1)).alias("trips"),
        F.min(price).alias("min_trip_value"), F.max(price).alias("max_trip_value"),
        F.stddev_samp(price).alias("std_trip_value"),
        *([] if approximate is None else [F.percentile_approx(price, 0.5, approximate).alias("median_trip_value")])).filter("trips > 0")
    totals = totals.withColumn("average_trip_value", F.col("total_revenue") / F.col("trips"))
    if approximate is not None:
        return totals
    median = exact_median(done, "trip_price", by).withColumnRenamed("median", "median_trip_value")
    if by:
        return totals.join(median, list(by))
    # two one-row results side by side without a join
    return (totals.unionByName(median, allowMissingColumns=True)
            .agg(*[F.max(c).alias(c) for c in [*totals.columns, "median_trip_value"]]).filter("trips > 0"))


def monthly_revenue_stats(series: DataFrame, population: bool = False) -> DataFrame:
    """Figures of each monthly series; ``population`` switches the deviation's divisor."""
    spread = F.stddev_pop if population else F.stddev_samp
    return series.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("total_months"), F.avg("revenue").alias("average_monthly"),
        F.median("revenue").alias("median_monthly"), F.min("revenue").alias("min_monthly"),
        F.max("revenue").alias("max_monthly"), spread("revenue").alias("std_monthly"),
        F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def open_lead_stats(leads: DataFrame, as_of) -> DataFrame:
    """Open leads and value in total (stage null) and by stage."""
    return (open_leads(leads, as_of).rollup("current_stage")
            .agg(F.count(F.lit(1)).alias("leads"), money_sum(F.col("trip_price")).alias("value"))
            .filter("leads > 0"))


def missing_values(leads: DataFrame) -> DataFrame:
    """Null count of every column, one row per column."""
    cols = leads.columns
    counted = leads.agg(*[count_of(F.col(c).isNull()).alias(c) for c in cols])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in cols])))


def duplicate_records(leads: DataFrame) -> DataFrame:
    """Rows equal to an earlier row in every column (nulls are equal). Copies of one row are
    combined before the shuffle, so a heavily repeated row does not skew it."""
    return (leads.groupBy(*leads.columns).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_records")))


def date_ranges(leads: DataFrame) -> DataFrame:
    return (leads.agg(
        F.min("inquiry_date").alias("inquiry_start"), F.max("inquiry_date").alias("inquiry_end"),
        F.min("trip_date").alias("trip_start"), F.max("trip_date").alias("trip_end"))
        .withColumn("trip_span_years", F.bround(_years(F.col("trip_start"), F.col("trip_end")), 2)))


def inquiry_date_range(leads: DataFrame) -> DataFrame:
    return leads.agg(F.min("inquiry_date").alias("min_date"), F.max("inquiry_date").alias("max_date"))


def top_categories(leads: DataFrame, column: str, k: int = 10) -> DataFrame:
    return value_counts(leads, column).orderBy(F.desc("leads"), column).limit(k)


def top_category(leads: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value; ties go to the alphabetically first."""
    return top_values(leads, [column], by).drop("column_name")


def top_values(leads: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value of every column, all counted in one pass; ties go to the alphabetically first."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))
    counted = (leads.select(*by, each.alias("_c")).select(*by, "_c.*").filter("v is not null")
               .groupBy(*by, "column_name", "v").agg(F.count(F.lit(1)).alias("leads")))
    best = F.min(F.struct((-F.col("leads")).alias("n"), "v"))
    return counted.groupBy(*by, "column_name").agg(best.alias("_b")).select(*by, "column_name", F.col("_b.v").alias("top"), (-F.col("_b.n")).alias("leads"))
