"""Rule-derived sentences over keyed statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foresail.functions.expr import count_of, money, ratio, series_labels
from foresail.operators.leads import _is_active, _is_future_trip
from foresail.session import settle

# fixed values: the sentences
RATE_STRONG = "Strong conversion rate of %s%% indicates effective sales processes."
RATE_SOLID = "Conversion rate of %s%% shows solid sales performance with room for improvement."
RATE_LOW = "Conversion rate of %s%% suggests opportunities to optimize sales processes."
TRIP_VALUE = "Average trip value of $%s provides solid revenue foundation."
TOTAL_REVENUE = "Total historical revenue of $%s demonstrates strong business performance."
MONTHLY_REVENUE = "Average monthly revenue of $%s indicates stable revenue streams."
HISTORY_SPAN = "Historical data spans %d months, providing robust foundation for forecasting."
MODEL_ACCURACY = "Seasonal model shows strong accuracy with MAPE of %s%%."
TOP_SOURCE = "%s is the primary lead source (%d leads)"
TOP_DESTINATION = "%s is the most popular destination (%d trips)"
RATE_DRIVER = "Conversion rate of %s%% indicates strong sales performance"
VALUE_DRIVER = "Average trip value of $%s supports premium positioning"
OPEN_DRIVER = "Active pipeline of %d leads with $%s potential revenue"
DEFAULT_INSIGHTS = ("Revenue forecast shows stable growth trajectory.",
                    "Historical patterns indicate consistent performance.",
                    "Forecast accounts for seasonal variations.")
DEFAULT_DRIVERS = ("Historical revenue trends", "Market demand patterns", "Customer acquisition channels")
LIMIT = 5


def lead_statistics(leads: DataFrame, as_of, keys: Sequence[str] = ()) -> DataFrame:
    """Per series: completion, prices, open leads, top source and destination.

    One aggregate by (keys, source, destination) over the leads, settled, feeds all of it."""
    done = F.col("current_stage") == "completed"
    is_open = _is_active(as_of) | _is_future_trip(as_of)
    price = money(F.col("trip_price"))
    dims = list(dict.fromkeys([*keys, "lead_source", "destination"]))
    base = leads.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("total"), count_of(done).alias("completed"),
        F.sum(F.when(done, price)).alias("revenue"), F.count(F.when(done, price)).alias("priced"),
        count_of(is_open).alias("open_leads"), F.sum(F.when(is_open, price)).alias("open_value"))
    base = settle(base).withColumn("series_id", F.explode(series_labels(keys)))
    totals = base.groupBy("series_id").agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c)
        for c in ("total", "completed", "revenue", "priced", "open_leads", "open_value")])

    def top(column: str, name: str) -> DataFrame:
        counts = (base.filter(F.col(column).isNotNull()).groupBy("series_id", column)
                  .agg(F.sum("total").alias("n")))
        best = F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))
        return counts.groupBy("series_id").agg(best.alias("b")).select(
            "series_id", F.col("b.v").alias(name), (-F.col("b.n")).alias(f"{name}_leads"))

    revenue, value = F.col("revenue").cast("double"), F.col("open_value").cast("double")
    return (totals.withColumn("revenue", revenue).withColumn("open_value", value)
            .withColumn("rate", F.bround(ratio(F.col("completed") * 100, F.col("total")), 2))
            .withColumn("average_price", ratio(F.col("revenue"), F.col("priced")))
            .join(top("lead_source", "top_source"), "series_id", "left")
            .join(top("destination", "top_destination"), "series_id", "left"))


def _say(when: Column, template: str, *values: Column) -> Column:
    return F.when(when, F.format_string(template, *values))


def _dollars(c: Column) -> Column:
    return F.format_number(c, 0)


def _percent(c: Column) -> Column:
    return F.format_string("%.1f", F.bround(c, 1))


def _first_five(sentences: list[Column], defaults: Sequence[str]) -> Column:
    said = F.array_compact(F.array(*sentences))
    return F.when(F.size(said) > 0, F.slice(said, 1, LIMIT)).otherwise(F.array(*[F.lit(s) for s in defaults]))


def insights(stats: DataFrame, monthly_stats: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Up to five sentences per series. ``metrics`` (series_id, mape as fraction) is optional."""
    joined = stats.join(monthly_stats.select("series_id", "average_monthly", "total_months"), "series_id", "left")
    joined = (joined.join(metrics.select("series_id", "mape"), "series_id", "left") if metrics is not None
              else joined.withColumn("mape", F.lit(None).cast("double")))
    rate, average, total = F.col("rate"), F.col("average_price"), F.col("revenue")
    monthly, months, mape = F.col("average_monthly"), F.col("total_months"), F.col("mape") * 100
    percent = _percent(rate)
    said = [
        F.when(rate > 30, F.format_string(RATE_STRONG, percent))
        .when(rate > 20, F.format_string(RATE_SOLID, percent))
        .when(rate > 0, F.format_string(RATE_LOW, percent)),
        _say(average > 0, TRIP_VALUE, _dollars(average)),
        _say(total > 0, TOTAL_REVENUE, _dollars(total)),
        _say(monthly > 0, MONTHLY_REVENUE, _dollars(monthly)),
        _say(months >= 12, HISTORY_SPAN, months),
        _say(mape < 15, MODEL_ACCURACY, _percent(mape)),
    ]
    return joined.select("series_id", _first_five(said, DEFAULT_INSIGHTS).alias("insights"))


def key_drivers(stats: DataFrame) -> DataFrame:
    rate, average = F.col("rate"), F.col("average_price")
    said = [
        _say(F.col("top_source").isNotNull(), TOP_SOURCE, F.col("top_source"), F.col("top_source_leads")),
        _say(F.col("top_destination").isNotNull(), TOP_DESTINATION, F.col("top_destination"),
             F.col("top_destination_leads")),
        _say(rate > 0, RATE_DRIVER, _percent(rate)),
        _say(average > 0, VALUE_DRIVER, _dollars(average)),
        _say(F.col("open_leads") > 0, OPEN_DRIVER, F.col("open_leads"), _dollars(F.col("open_value"))),
    ]
    return stats.select("series_id", _first_five(said, DEFAULT_DRIVERS).alias("key_drivers"))
