"""Row-level lead operators: filters, labels and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foresail.functions.expr import as_date
from foresail.schema import ACTIVE_STAGES, PEAK_MONTHS, RESOLVED_STAGES


def completed_trips(leads: DataFrame) -> DataFrame:
    return leads.filter((F.col("current_stage") == "completed") & F.col("trip_date").isNotNull())


def as_of_cutoff(leads: DataFrame, as_of=None) -> DataFrame:
    return leads if as_of is None else leads.filter(F.col("trip_date") <= as_date(as_of))


def _is_active(as_of):
    return (F.col("inquiry_date") <= as_date(as_of)) & F.col("current_stage").isin(*ACTIVE_STAGES)


def _is_future_trip(as_of):
    return (F.col("current_stage") == "completed") & (F.col("trip_date") > as_date(as_of))


def active_leads(leads: DataFrame, as_of) -> DataFrame:
    """Leads inquired by ``as_of`` that are still in one of the four active stages."""
    return leads.filter(_is_active(as_of))


def open_leads(leads: DataFrame, as_of) -> DataFrame:
    """Active leads plus completed trips that lie after ``as_of``, seen as final_payment.

    The two groups are disjoint, so one scan with one condition replaces the union."""
    return (leads.filter(_is_active(as_of) | _is_future_trip(as_of))
            .withColumn("current_stage", F.when(_is_future_trip(as_of), "final_payment")
                        .otherwise(F.col("current_stage"))))


def resolved_leads(leads: DataFrame) -> DataFrame:
    return (leads.filter(F.col("current_stage").isin(*RESOLVED_STAGES))
            .withColumn("converted", (F.col("current_stage") == "completed").cast("int")))


def inquiry_cohort(leads: DataFrame, start, end) -> DataFrame:
    return leads.filter(F.col("inquiry_date").between(as_date(start), as_date(end)))


def lead_features(leads: DataFrame) -> DataFrame:
    """Calendar features of the inquiry; unknown numbers become 0."""
    inquiry = F.col("inquiry_date")
    return (leads
            .withColumn("inquiry_month", F.month(inquiry))
            .withColumn("inquiry_quarter", F.quarter(inquiry))
            .withColumn("inquiry_year", F.year(inquiry))
            .withColumn("is_peak_season", F.month(inquiry).isin(*PEAK_MONTHS).cast("int"))
            .na.fill(0, ["duration_days", "is_repeat_customer", "inquiry_month", "inquiry_quarter",
                         "inquiry_year", "is_peak_season"]))
