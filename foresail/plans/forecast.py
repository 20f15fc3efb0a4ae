"""Twelve-month ensemble forecast for every series.

The leads are scanned once into a small cube (segment x stage x source x repeat x month, bounded
by the dimensions and the calendar). The cube is settled in the shared folder and every
component - monthly series, conversion rates, open value - is derived from it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from foresail.functions.expr import as_date, money, month_of, months_after
from foresail.operators import forecasts as P
from foresail.operators.reporting import combined_series, monthly_bookings
from foresail.operators.rates import SEGMENT, rates_from_counts, rule_totals, weighted_open_value
from foresail.operators.series import (drop_anomalous_last_month, finish_monthly, roll_up, series_profile,
                                       trimmed_series)
from foresail.operators.stats import history_span
from foresail.plans.trend import seasonal_forecast
from foresail.schema import ACTIVE_STAGES, FUNNEL_STAGES, STAGE_DATE
from foresail.session import settle


def lead_cube(leads: DataFrame, keys: Sequence[str], as_of) -> DataFrame:
    """Everything the forecast needs from the leads, counted in one combined aggregate.

    ``month`` is the trip month of completed trips and ``past`` whether the trip lies before or on
    ``as_of``; ``open_stage`` is the stage in which a lead is still open; the dated flags are those
    the conversion rates ask for."""
    day = as_date(as_of)
    done = F.col("current_stage") == "completed"
    future = done & (F.col("trip_date") > day)
    active = (F.col("inquiry_date") <= day) & F.col("current_stage").isin(*ACTIVE_STAGES)
    dims = list(dict.fromkeys([*keys, *SEGMENT]))
    return leads.groupBy(
        *dims, "current_stage",
        F.when(done, month_of(F.col("trip_date"))).alias("month"),
        F.coalesce(done & (F.col("trip_date") <= day), F.lit(False)).alias("past"),
        F.when(future, "final_payment").when(active, F.col("current_stage")).alias("open_stage"),
        *[(done & F.col(STAGE_DATE[s]).isNotNull()).alias(f"dated_{s}") for s in ACTIVE_STAGES[1:]],
    ).agg(F.count(F.lit(1)).alias("leads"), F.count("lead_id").alias("trips"),
          F.sum(money(F.col("trip_price"))).alias("value"))


def cube_monthly(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Monthly revenue and trips up to the cube's date."""
    return finish_monthly(roll_up(cube.filter("past"), keys, ["month"], {"r": "value", "n": "trips"}))


def cube_bookings(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Completed trips by month, later ones included."""
    return roll_up(cube.filter(F.col("month").isNotNull()), keys, ["month"], {"trip_count": "leads"})


def cube_rates(cube: DataFrame) -> DataFrame:
    """Conversion rates from the cube: the rate rule on rows that stand for ``leads`` leads."""
    done = F.col("current_stage") == "completed"
    n = F.col("leads")
    rows = []
    for i, s in enumerate(ACTIVE_STAGES):
        reached = F.lit(True) if i == 0 else F.col("current_stage").isin(*FUNNEL_STAGES[i:])
        finished = done if i == 0 else F.col(f"dated_{s}")
        rows.append(F.struct(F.lit(s).alias("stage"), F.when(finished, n).otherwise(0).alias("completed"),
                             F.when(reached, n).otherwise(0).alias("total")))
    return rates_from_counts(cube.select(*SEGMENT, F.inline(F.array(*rows))))


def cube_open_value(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    dims = list(dict.fromkeys([*keys, "current_stage", *SEGMENT]))
    return (cube.filter(F.col("open_stage").isNotNull()).withColumn("current_stage", F.col("open_stage"))
            .groupBy(*dims).agg(F.sum("leads").alias("leads"), F.sum("value").alias("value")))


def rules_component(totals: DataFrame, profile: DataFrame, as_of) -> DataFrame:
    """Expected revenue of the open leads spread over twelve months.

    Without any, the mean of the last twelve months stands in. Series with open leads but no
    history start in the month of ``as_of``."""
    both = profile.join(totals, "series_id", "full_outer")
    start = F.coalesce(months_after(F.col("last_month"), 1), month_of(as_date(as_of)))
    total = F.coalesce(F.col("total"), F.lit(0.0))
    monthly = F.when((total == 0) & F.col("last_month").isNotNull(), F.col("plain_mean_12")).otherwise(
        F.greatest(total, F.lit(0.0)) / 12)
    return P.spread_months(both, start, monthly, 0.8, 1.2, "rules")


def scored_component(totals: DataFrame, profile: DataFrame, as_of) -> DataFrame:
    """Model-scored revenue of the open leads spread over twelve months; left out when <= 0."""
    both = totals.filter("total > 0").join(profile, "series_id", "left")
    start = F.coalesce(months_after(F.col("last_month"), 1), month_of(as_date(as_of)))
    return P.spread_months(both, start, F.col("total") / 12, 0.7, 1.3, "scored")


def seasonal_component(history: DataFrame, profile: DataFrame, growth: str | None = None) -> DataFrame:
    """The trend model anchored on recent history: damped, capped and varied."""
    raw = P.with_history(seasonal_forecast(history, growth), profile)
    shaped = P.component_variation(P.cap_to_history(P.dampen_start(P.clip_non_negative(raw)), "plain_mean_6"))
    return P.known_columns(shaped).withColumn("method", F.lit("seasonal"))


def finish_ensemble(ensemble: DataFrame, profile: DataFrame) -> DataFrame:
    """Cap, smooth, vary, rebuild the band and lead in from the last month - in this order."""
    rows = P.cap_to_history(P.clip_non_negative(P.with_history(ensemble, profile)))
    smoothed = P.ewm_smooth(rows).withColumn(
        "forecast", F.when(F.col("last_revenue").isNotNull(), F.col("smoothed")).otherwise(F.col("forecast")))
    rows = P.transition_blend(P.interval_rebuild(P.ensemble_variation(smoothed)))
    return P.known_columns(rows).withColumn("method", F.lit("ensemble"))


def cube_history(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trimmed monthly series of the cube."""
    return trimmed_series(cube_monthly(cube, keys))


def cube_rule_totals(cube: DataFrame, keys: Sequence[str], rates: DataFrame | None = None) -> DataFrame:
    """Weighted open value per series, with the cube's own rates unless others are given."""
    return rule_totals(cube_weighted(cube, keys, rates), keys)


def cube_weighted(cube: DataFrame, keys: Sequence[str], rates: DataFrame | None = None) -> DataFrame:
    return weighted_open_value(cube_open_value(cube, keys), cube_rates(cube) if rates is None else rates)


def forecast_from_cube(cube: DataFrame, as_of, keys: Sequence[str] = (), scored_totals: DataFrame | None = None,
                       rates: DataFrame | None = None, use_seasonal: bool = True,
                       use_rules: bool = True) -> DataFrame:
    """The ensemble from a (settled) cube; see ``forecast_12_months``."""
    if not (use_seasonal or use_rules or scored_totals is not None):
        raise ValueError("no forecast component is enabled")
    history = drop_anomalous_last_month(cube_history(cube, keys))
    if use_seasonal:
        history = settle(history)  # months x series; read by the model and the profile
    profile = series_profile(history)
    parts = []
    if use_seasonal:
        parts.append(seasonal_component(history, profile))
    if scored_totals is not None:
        parts.append(scored_component(scored_totals, profile, as_of))
    if use_rules:
        parts.append(rules_component(cube_rule_totals(cube, keys, rates), profile, as_of))
    return finish_ensemble(P.combine(reduce(DataFrame.unionByName, parts)), profile)


def forecast_12_months(leads: DataFrame, as_of, keys: Sequence[str] = (), min_years: float | None = None, **components) -> DataFrame:
    """Ensemble forecast per series: month, forecast, lower, upper, method.

    With ``min_years`` leads whose completed trips span less are refused.
    ``scored_totals`` (series_id, total) adds the model-scored component; ``rates`` replaces the
    rates learned from the leads, e.g. by ones loaded from the artifact store; ``use_seasonal``
    and ``use_rules`` switch the other components off."""
    if min_years is not None:
        span = history_span(leads, min_years).first()
        if not span.eligible:
            raise ValueError(f"completed history spans {span.years or 0:.2f} years; {min_years} required")
    return forecast_from_cube(settle(lead_cube(leads, keys, as_of)), as_of, keys, **components)


def chart_points(cube: DataFrame, as_of, keys: Sequence[str] = (), **components) -> DataFrame:
    """History with bookings and the forecast as one set of points."""
    history = monthly_bookings(cube_history(cube, keys), cube_bookings(cube, keys))
    return combined_series(history, forecast_from_cube(cube, as_of, keys, **components))
