"""Named queries over the given tables, one or more per operator.

Doubles are rounded here, and only here: money that is a sum or a mean of cents to 4 places,
model values to 2, ratios to 6 - so that results can be compared with an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from foresail.functions.expr import as_date
from foresail.operators import completeness, forecasts as P, funnel, insights as G, leads as B, rates as R
from foresail.operators import reporting as D, scenarios, series as S, stats as ST
from foresail.plans import conversion_model as M, forecast as FC, trend as T
from foresail.plans.boosting import tree_rows
from foresail.session import bounded, scratch_path, settle
from foresail.sources import csv_leads, sinks
from foresail.sources.artifacts import ArtifactStore
from foresail.sources.snapshots import SnapshotStore
from foresail.sources.tables import FIXTURE_AS_OF as AS_OF, leads_from_orders, read_table, supplier_sales
from foresail.streaming.uploads import stream_monthly_revenue

KEYS = ("destination",)
COHORT = ("2000-01-01", "2000-12-31")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int = 4, **special: int) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, special.get(f.name, places))
                           for f in df.schema.fields if isinstance(f.dataType, DoubleType)})


# --- inputs ------------------------------------------------------------------------------

def _leads(spark, sf):
    return leads_from_orders(spark, sf)


def _monthly(spark, sf):
    return S.monthly_revenue(_leads(spark, sf), KEYS, AS_OF)


def _filled(spark, sf):
    return S.fill_missing_months(_monthly(spark, sf))


def _history(spark, sf):
    return S.trimmed_series(_monthly(spark, sf))


def _cube(spark, sf):
    """One scan of the leads for everything derived from months, stages and segments."""
    return settle(FC.lead_cube(_leads(spark, sf), KEYS, AS_OF))


def _anchored(spark, sf):
    """Trimmed history without an anomalous last month, settled because several branches read it."""
    return settle(S.drop_anomalous_last_month(_history(spark, sf)))


def _forecast(spark, sf):
    return FC.forecast_12_months(_leads(spark, sf), AS_OF, KEYS)


def _points(spark, sf):
    return FC.chart_points(_cube(spark, sf), AS_OF, KEYS)


def _seasonal_with_profile(spark, sf):
    history = _anchored(spark, sf)
    return P.with_history(T.seasonal_forecast(history), S.series_profile(history))


def _weighted(spark, sf):
    return FC.cube_weighted(_cube(spark, sf), KEYS)


def _score():
    """A plain score on lead features, standing in for a model where results must be exact."""
    return (F.col("duration_days") + F.col("inquiry_month") * 3 + F.col("is_repeat_customer") * 20) / 100.0


def _bands(df, places=2):
    return rounded(df.select("series_id", "month", "forecast", "lower", "upper"), places)


# --- sources and sinks -------------------------------------------------------------------

@query
def a1_read_leads_csv(spark, sf):
    path = scratch_path(spark, "leads-csv")
    csv_leads.write_leads_csv(_leads(spark, sf), path)
    notes = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("", "# note", "  # indented", ",,,,,,,,,,,")])))
    notes.coalesce(1).write.mode("append").text(path)
    return csv_leads.read_leads_csv(spark, path)


@query
def a1_read_mixed_csv(spark, sf):
    """Two folders with their columns in other orders; sources with commas, quotes and line breaks, one extra column."""
    leads = _leads(spark, sf).withColumn("lead_source", F.when(F.substring("lead_id", 6, 20).cast("long") % 3 == 0, F.concat(
        "lead_source", F.lit('\nby "phone", twice\nand mail'))).otherwise(F.col("lead_source")))
    path = scratch_path(spark, "mixed-csv")
    csv_leads.write_leads_csv(leads.filter("is_repeat_customer = 0"), f"{path}/one")
    csv_leads.write_leads_csv(leads.filter("is_repeat_customer = 1").select(F.lit("x\ny").alias("remark"), *reversed(leads.columns)), f"{path}/two")
    return csv_leads.read_leads_csv(spark, [f"{path}/one", f"{path}/two"])


@query
def a2_require_columns(spark, sf):
    return csv_leads.require_columns(_leads(spark, sf)).agg(F.count(F.lit(1)).alias("leads"))


@query
def a3_coerce_dates(spark, sf):
    """Dates as text; every tenth lead has blanks, every next one an impossible date."""
    number = F.substring("lead_id", 6, 20).cast("long") % 10
    dates = ("inquiry_date", "trip_date", "booking_date", "quote_date", "final_payment_date")
    text = _leads(spark, sf).select("lead_id", *[
        F.when(number == 0, " ").when(number == 1, "2023-13-40").otherwise(F.col(c).cast("string")).alias(c)
        for c in dates])
    return csv_leads.coerce_dates(text)


@query
def a4_export_series_csv(spark, sf):
    """Written as CSV and read back by each file's header."""
    path = scratch_path(spark, "series-csv")
    sinks.export_series_csv(_points(spark, sf), path)
    return sinks.read_series_csv(spark, path).select(
        "series_id", F.to_date("Date", "MMM yyyy").alias("month"), F.col("Date").alias("date_text"), F.col("Revenue").alias("revenue_text"),
        F.col("Type").alias("type_text"), F.nullif("Bookings", F.lit("")).alias("bookings_text"))


@query
def a5_write_forecast_json(spark, sf):
    path = scratch_path(spark, "forecast-json")
    sinks.write_forecast_json(_forecast(spark, sf), path)
    back = spark.read.schema("date string, forecast double, lower double, upper double, series_id string").json(path)
    return rounded(back, 2)


@query
def a6_artifact_store(spark, sf):
    store = ArtifactStore(spark, scratch_path(spark, "artifacts"))
    store.save_table("rates", R.conversion_rates(_leads(spark, sf)))
    return rounded(store.load_table("rates"), 6)


@query
def a6_model_round_trip(spark, sf):
    """A model of one round, saved over another one and loaded again: its splits and leaves."""
    store = ArtifactStore(spark, scratch_path(spark, "artifacts"))
    model, _ = M.train_conversion_model(_leads(spark, sf), rounds=1)
    store.save_model("conversion", M.ConversionModel(model.trees * 2, model.codes))
    store.save_model("conversion", model)
    return _tree_table(spark, store.load_model("conversion"))


@query
def a7_saved_forecasts(spark, sf):
    """Three snapshots, one of them deleted by an admin; newest first."""
    store = SnapshotStore(spark, scratch_path(spark, "snapshots"))
    history = _anchored(spark, sf)
    for ident, name, who, when, growth in (("s1", "first", "ana", "2001-08-01 10:00:00", None),
                                           ("s2", "linear", "bo", "2001-08-02 10:00:00", "linear"),
                                           ("s3", "draft", "cy", "2001-08-03 10:00:00", None)):
        store.save(T.seasonal_forecast(history, growth), name, who, when, ident)
    store.delete("s1", "analyst")
    store.delete("s3", "admin")
    total = F.aggregate("data", F.lit(0.0), lambda acc, x: acc + x["forecast"])
    return rounded(store.newest_first().select(
        "id", "name", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("saved"), "created_by", "series_id",
        F.size("data").alias("points"), total.alias("total")), 2)


# --- projections and filters -------------------------------------------------------------

@query
def b1_completed_trips(spark, sf):
    return B.completed_trips(_leads(spark, sf)).select("lead_id", "destination", "trip_date", "trip_price")


@query
def b2_as_of_cutoff(spark, sf):
    return (B.as_of_cutoff(B.completed_trips(_leads(spark, sf)), AS_OF)
            .select("lead_id", "destination", "trip_date", "trip_price"))


@query
def b3_active_leads(spark, sf):
    return B.active_leads(_leads(spark, sf), AS_OF).select("lead_id", "inquiry_date", "current_stage", "trip_price")


@query
def b4_reclassify_future_trips(spark, sf):
    return B.open_leads(_leads(spark, sf), AS_OF).select("lead_id", "inquiry_date", "trip_date", "current_stage",
                                                         "trip_price")


@query
def b5_resolved_leads(spark, sf):
    return B.resolved_leads(_leads(spark, sf)).select("lead_id", "current_stage", "converted")


@query
def b6_inquiry_cohort(spark, sf):
    return B.inquiry_cohort(_leads(spark, sf), *COHORT).select("lead_id", "inquiry_date", "current_stage")


@query
def b7_filter_series(spark, sf):
    points = D.filter_series(_points(spark, sf), False, "2001-01-01", "2001-12-31")
    return rounded(points.select("series_id", "month", "type", "revenue"), 2)


def _response(spark, sf):
    leads = _leads(spark, sf)
    stats = G.lead_statistics(leads, AS_OF, KEYS)
    said = G.insights(stats, ST.monthly_revenue_stats(_history(spark, sf)))
    return said.join(G.key_drivers(stats), "series_id")


@query
def b8_mask_for_role(spark, sf):
    response = settle(_response(spark, sf))  # computed once, not once per role
    views = [D.mask_for_role(response, role).select(
        F.lit(role).alias("role"), "series_id", F.array_join("insights", " / ").alias("insights"),
        F.array_join("key_drivers", " / ").alias("key_drivers")) for role in ("admin", "analyst")]
    return views[0].unionByName(views[1])


@query
def b9_funnel_visibility(spark, sf):
    counts = funnel.stage_counts(_leads(spark, sf))
    return rounded(funnel.funnel_visibility(counts, show_lost=True))


@query
def b10_lead_features(spark, sf):
    return B.lead_features(_leads(spark, sf)).select(
        "lead_id", "duration_days", "is_repeat_customer", "inquiry_month", "inquiry_quarter", "inquiry_year",
        "is_peak_season")


# --- joins -------------------------------------------------------------------------------

@query
def c1_fill_missing_months(spark, sf):
    return rounded(_filled(spark, sf))


def _components(cube):
    """Seasonal and rules component with the profile they are anchored on."""
    history = settle(S.drop_anomalous_last_month(FC.cube_history(cube, KEYS)))
    profile = S.series_profile(history)
    rules = FC.rules_component(FC.cube_rule_totals(cube, KEYS), profile, AS_OF)
    return FC.seasonal_component(history, profile).unionByName(rules), profile


@query
def c2_ensemble_merge(spark, sf):
    return rounded(P.combine(_components(_cube(spark, sf))[0]), 2)


@query
def c3_lookup_conversion_rate(spark, sf):
    leads = _leads(spark, sf)
    looked = R.lookup_conversion_rate(B.open_leads(leads, AS_OF), bounded(R.conversion_rates(leads)))
    return rounded(looked.select("lead_id", "current_stage", "conversion_rate", "tier"), 6)


@query
def c3_tier_usage(spark, sf):
    return R.tier_usage(_weighted(spark, sf))


@query
def c4_monthly_bookings(spark, sf):
    cube = _cube(spark, sf)
    return rounded(D.monthly_bookings(FC.cube_history(cube, KEYS), FC.cube_bookings(cube, KEYS)))


@query
def c5_encode_category(spark, sf):
    """Sources encoded with the dictionary of resolved leads."""
    leads = _leads(spark, sf)
    codes = bounded(M.category_codes(B.resolved_leads(leads), "lead_source"))
    return M.encode_category(leads, "lead_source", codes).select("lead_id", "lead_source", "lead_source_code")


def _periods(leads):
    return leads.select(F.date_format("inquiry_date", "yyyy-MM").alias("period"), "inquiry_date")


@query
def c6_new_categories(spark, sf):
    """Inquiry periods a dictionary learned before 2001 does not know."""
    periods = _periods(_leads(spark, sf))
    known = M.category_codes(periods.filter(F.col("inquiry_date") < as_date("2001-01-01")), "period")
    return M.new_categories(periods, "period", known)


# --- aggregations ------------------------------------------------------------------------

@query
def d1_monthly_revenue(spark, sf):
    return rounded(_monthly(spark, sf))


@query
def d1_supplier_series(spark, sf):
    """The same aggregation over line items keyed by supplier: many series."""
    return rounded(S.monthly_revenue(supplier_sales(spark, sf), ("supplier",)))


@query
def d2_history_span(spark, sf):
    return rounded(ST.history_span(_leads(spark, sf), by=KEYS), 6)


@query
def d3_load_metadata(spark, sf):
    return rounded(ST.load_metadata(_leads(spark, sf)), conversion_rate=6)


@query
def d4_stage_distribution(spark, sf):
    return ST.stage_distribution(_leads(spark, sf))


@query
def d4_completion_rate(spark, sf):
    return ST.completion_rate(_leads(spark, sf), KEYS)


@query
def d5_revenue_stats(spark, sf):
    return rounded(ST.revenue_stats(_leads(spark, sf)))


@query
def d5_revenue_stats_by_destination(spark, sf):
    return rounded(ST.revenue_stats(_leads(spark, sf), KEYS))


@query
def d6_monthly_revenue_stats(spark, sf):
    return rounded(ST.monthly_revenue_stats(_history(spark, sf)))


@query
def d7_destination_distribution(spark, sf):
    return ST.value_counts(_leads(spark, sf), "destination")


@query
def d8_lead_source_distribution(spark, sf):
    return ST.value_counts(_leads(spark, sf), "lead_source")


@query
def d9_open_lead_stats(spark, sf):
    return rounded(ST.open_lead_stats(_leads(spark, sf), AS_OF))


@query
def d10_missing_values(spark, sf):
    return ST.missing_values(_leads(spark, sf))


@query
def d11_duplicate_records(spark, sf):
    """All columns of all leads, every tenth lead once more."""
    leads = _leads(spark, sf)
    again = leads.filter(F.substring("lead_id", 6, 20).cast("long") % 10 == 0)
    return ST.duplicate_records(leads.unionByName(again))


@query
def d12_date_ranges(spark, sf):
    return ST.date_ranges(_leads(spark, sf))


@query
def d13_funnel_date_range(spark, sf):
    return ST.inquiry_date_range(_leads(spark, sf))


@query
def d14_flat_conversion_rates(spark, sf):
    return rounded(R.flat_conversion_rates(_leads(spark, sf)), 6)


@query
def d15_segment_conversion_rates(spark, sf):
    return rounded(R.segment_conversion_rates(_leads(spark, sf)), 6)


@query
def d16_conversion_summary(spark, sf):
    return R.conversion_summary(R.conversion_rates(_leads(spark, sf)))


@query
def d17_funnel_cohort(spark, sf):
    return rounded(funnel.funnel_cohort(_leads(spark, sf), *COHORT, by=KEYS))


@query
def d18_funnel_current(spark, sf):
    return rounded(funnel.funnel_current(_leads(spark, sf), AS_OF, by=KEYS))


@query
def d19_funnel_rates(spark, sf):
    return rounded(funnel.funnel_rates(funnel.funnel_cohort(_leads(spark, sf), *COHORT, by=KEYS), KEYS))


@query
def d19_funnel_rates_current(spark, sf):
    return rounded(funnel.funnel_rates(funnel.funnel_current(_leads(spark, sf), AS_OF)))


@query
def d20_funnel_summary(spark, sf):
    return rounded(funnel.funnel_summary(funnel.funnel_cohort(_leads(spark, sf), *COHORT, by=KEYS), KEYS), 6,
                   total_potential=2)


@query
def d21_open_value_details(spark, sf):
    return rounded(R.open_value_details(_weighted(spark, sf)), 2)


@query
def d22_forecast_summary(spark, sf):
    return rounded(D.forecast_summary(_forecast(spark, sf)), 2, coefficient_of_variation=6)


@query
def d23_horizon_kpis(spark, sf):
    """The ensemble against the plain seasonal forecast as baseline."""
    cube = _cube(spark, sf)
    plain = T.seasonal_forecast(S.drop_anomalous_last_month(FC.cube_history(cube, KEYS)))
    kpis = D.horizon_kpis(FC.chart_points(cube, AS_OF, KEYS), plain)
    return rounded(kpis, 2, diff_pct=6, compare_1mo=6, compare_3mo=6, compare_6mo=6)


@query
def d24_series_stats_population(spark, sf):
    return rounded(ST.monthly_revenue_stats(_history(spark, sf), population=True))


@query
def d25_executive_growth(spark, sf):
    return rounded(D.executive_growth(_points(spark, sf)), 2, growth_pct=6)


@query
def d26_forecast_vs_history(spark, sf):
    return rounded(D.forecast_vs_history(_points(spark, sf)), 2, growth_pct=6)


@query
def d27_quarterly_forecast(spark, sf):
    return rounded(D.quarterly_forecast(_forecast(spark, sf)), 2, q1_to_q4_pct=6)


@query
def d28_peak_trough(spark, sf):
    return rounded(D.peak_trough(_forecast(spark, sf)), 2)


@query
def d29_trend_class(spark, sf):
    return rounded(D.trend_class(_forecast(spark, sf)), 2, trend_pct=6)


@query
def d30_volatility_class(spark, sf):
    return rounded(D.volatility_class(_forecast(spark, sf)), 6)


@query
def d31_top_category(spark, sf):
    return ST.top_values(_leads(spark, sf), ["lead_source", "destination"])


def _scored_split(spark, sf):
    split = B.lead_features(M.stratified_split(B.resolved_leads(_leads(spark, sf))))
    return split.withColumn("score", _score())


@query
def d32_classification_metrics(spark, sf):
    return rounded(M.classification_metrics(_scored_split(spark, sf), by=("is_test",)), 6)


@query
def d33_backtest_metrics(spark, sf):
    return rounded(T.backtest_metrics(T.rolling_origin(settle(_history(spark, sf)))), 2, mape=6, mse=-3)


# --- windows and time series -------------------------------------------------------------

@query
def e1_trailing_nonzero_mean(spark, sf):
    return rounded(S.trailing_nonzero_mean(_filled(spark, sf)))


@query
def e2_flag_incomplete_months(spark, sf):
    flagged = S.flag_incomplete_months(_filled(spark, sf))
    return rounded(flagged.withColumn("rn_desc", F.col("rn_desc").cast("long")))


@query
def e3_trim_incomplete_tail(spark, sf):
    return rounded(S.trim_incomplete_tail(S.flag_incomplete_months(_filled(spark, sf))))


@query
def e4_drop_collapsed_last_month(spark, sf):
    return rounded(_history(spark, sf))


@query
def e4_supplier_series(spark, sf):
    return rounded(S.trimmed_series(S.monthly_revenue(supplier_sales(spark, sf), ("supplier",), AS_OF)))


@query
def e5_drop_anomalous_last_month(spark, sf):
    return rounded(S.drop_anomalous_last_month(_filled(spark, sf)))


@query
def e6_recent_stats(spark, sf):
    return rounded(S.series_profile(_anchored(spark, sf)))


@query
def e7_growth_mode(spark, sf):
    return rounded(S.growth_mode(_anchored(spark, sf)))


@query
def e8_month_over_month(spark, sf):
    rows = D.month_over_month(_forecast(spark, sf))
    return rounded(rows.select("series_id", "month", "forecast", "mom_pct"), 2, mom_pct=6)


@query
def e9_deviation_from_mean(spark, sf):
    rows = D.deviation_from_mean(_forecast(spark, sf))
    return rounded(rows.select("series_id", "month", "vs_mean", "deviation_pct"), 6)


@query
def e10_ewm_smooth(spark, sf):
    """Smoothing of the whole monthly history."""
    history = _history(spark, sf).withColumnRenamed("revenue", "forecast")
    return rounded(P.ewm_smooth(history).select("series_id", "month", "smoothed"), 2)


@query
def e11_seeded_variation(spark, sf):
    rows = _seasonal_with_profile(spark, sf)
    plain = rows.withColumn("plain", F.col("forecast"))
    component = (P.component_variation(plain).withColumn("component", F.col("forecast"))
                 .withColumn("forecast", F.col("plain")))
    both = P.ensemble_variation(component).select("series_id", "month", "component", F.col("forecast").alias("ensemble"))
    return rounded(both, 2)


@query
def e12_transition_blend(spark, sf):
    return _bands(P.transition_blend(_seasonal_with_profile(spark, sf)))


@query
def e13_dampen_start(spark, sf):
    return _bands(P.dampen_start(_seasonal_with_profile(spark, sf)))


@query
def e14_cap_forecast(spark, sf):
    return _bands(P.cap_to_history(P.cap_outliers(P.clip_non_negative(
        _seasonal_with_profile(spark, sf)))))


@query
def e15_interval_rebuild(spark, sf):
    return _bands(P.interval_rebuild(_seasonal_with_profile(spark, sf)))


@query
def e16_chart_rows(spark, sf):
    rows = D.chart_rows(_points(spark, sf)).select(
        "series_id", "month", F.col("index").cast("long").alias("row_index"), "prev_revenue", "revenue_historical",
        "revenue_forecast", F.col("confidence_band")[0].alias("band_low"), F.col("confidence_band")[1].alias("band_high"),
        "half_width", "date_label", F.col("transition_index").cast("long").alias("transition_index"))
    return rounded(rows, 2)


# --- models ------------------------------------------------------------------------------

@query
def f1_category_codes(spark, sf):
    """Codes of the periods before 2001, later periods appended."""
    periods = _periods(_leads(spark, sf))
    known = M.category_codes(periods.filter(F.col("inquiry_date") < as_date("2001-01-01")), "period")
    return M.extend_codes(known, periods, "period").withColumn("code", F.col("code").cast("long"))


@query
def f2_stratified_split(spark, sf):
    return M.stratified_split(B.resolved_leads(_leads(spark, sf))).select("lead_id", "converted", "is_test")


def _model(spark, sf):
    return M.train_conversion_model(_leads(spark, sf))


@query
def f3_train_conversion_model(spark, sf):
    model, cube = _model(spark, sf)
    return rounded(M.classification_metrics(model.score(cube), weight="weight", by=("is_test",)), 6)


def _tree_table(spark, model):
    rows = [(node, None if f is None else M.FEATURES[f], cut, value) for _, node, f, cut, value in tree_rows(model.trees)]
    return rounded(spark.createDataFrame(rows, "node int, feature string, cut double, leaf_value double"), 6)


@query
def f3_first_tree(spark, sf):
    """Splits and leaves of the first round."""
    model, _ = M.train_conversion_model(_leads(spark, sf), rounds=1)
    return _tree_table(spark, model)


def _value_cube(spark, sf):
    return M.expected_value_cube(B.open_leads(_leads(spark, sf), AS_OF), KEYS)


@query
def f4_expected_revenue(spark, sf):
    scored = _value_cube(spark, sf).withColumn("score", _score())
    return rounded(M.expected_revenue(scored, KEYS), 2, mean_probability=6)


@query
def f4_expected_revenue_scored(spark, sf):
    model, _ = _model(spark, sf)
    return rounded(M.expected_revenue(model.score(_value_cube(spark, sf)), KEYS), 2, mean_probability=6)


@query
def f5_rule_forecast(spark, sf):
    return rounded(R.rule_totals(_weighted(spark, sf), KEYS), 2)


@query
def f6_spread_12_months(spark, sf):
    cube = _cube(spark, sf)
    profile = S.series_profile(S.drop_anomalous_last_month(FC.cube_history(cube, KEYS)))
    return rounded(FC.rules_component(FC.cube_rule_totals(cube, KEYS), profile, AS_OF), 2)


@query
def f7_seasonal_trend(spark, sf):
    return _bands(T.seasonal_forecast(_history(spark, sf)))


@query
def f7_seasonal_trend_linear(spark, sf):
    return _bands(T.seasonal_forecast(_history(spark, sf), "linear"))


@query
def f7_trend_changes(spark, sf):
    """Lines that may bend once."""
    return _bands(T.seasonal_forecast(_history(spark, sf), changes=True))


@query
def f7_supplier_changes(spark, sf):
    sales = S.monthly_revenue(supplier_sales(spark, sf), ("supplier",), AS_OF)
    model = T.fit_seasonal_trend(S.trimmed_series(sales), changes=True)
    return rounded(model.select("series_id", F.col("n").alias("months"), "kink", "bend"), 2)


@query
def f7_supplier_trend(spark, sf):
    """One model per supplier over line items."""
    sales = S.monthly_revenue(supplier_sales(spark, sf), ("supplier",), AS_OF)
    return _bands(T.seasonal_forecast(S.trimmed_series(sales)))


@query
def f8_rolling_origin_backtest(spark, sf):
    return rounded(T.rolling_origin(settle(_history(spark, sf))).withColumn("h", F.col("h").cast("long")), forecast=1)


@query
def f9_combine_ensemble(spark, sf):
    """Three components, one of them without a fixed weight."""
    cube = _cube(spark, sf)
    parts, profile = _components(cube)
    value = FC.cube_rule_totals(cube, KEYS)
    extra = FC.rules_component(value.withColumn("total", F.col("open_value")), profile, AS_OF)
    return rounded(P.combine(parts.unionByName(extra.withColumn("method", F.lit("full_value")))), 2)


@query
def f10_forecast_12_months(spark, sf):
    return rounded(_forecast(spark, sf), 2)


@query
def f10_forecast_with_scores(spark, sf):
    """All three components, the scored one from a given score column."""
    scored = _value_cube(spark, sf).withColumn("score", _score())
    return rounded(FC.forecast_12_months(_leads(spark, sf), AS_OF, KEYS,
                                         scored_totals=M.expected_revenue(scored, KEYS)), 2)


@query
def f10_forecast_with_model(spark, sf):
    """All three components with trained trees."""
    model, _ = _model(spark, sf)
    totals = M.expected_revenue(model.score(_value_cube(spark, sf)), KEYS)
    return rounded(FC.forecast_12_months(_leads(spark, sf), AS_OF, KEYS, scored_totals=totals), 2)


# --- rules -------------------------------------------------------------------------------

def _sentences(df, column):
    return df.select("series_id", F.posexplode(column).alias("place", "sentence"))


@query
def g1_insights(spark, sf):
    stats = G.lead_statistics(_leads(spark, sf), AS_OF, KEYS)
    return _sentences(G.insights(stats, ST.monthly_revenue_stats(_history(spark, sf))), "insights")


@query
def g2_key_drivers(spark, sf):
    return _sentences(G.key_drivers(G.lead_statistics(_leads(spark, sf), AS_OF, KEYS)), "key_drivers")


def _reports(spark, sf):
    """Report documents made from the text table: its sentences are dealt to the seven sections
    in turn, with the sentence, its last word and its first word as an item's fields."""
    sections = completeness.SECTIONS
    sentences = F.split("text", r"\. ")

    def item(s, fields):
        if not fields:
            return s
        parts = (s, F.regexp_extract(s, r"[^ ]*$", 0), F.regexp_extract(s, r"^[^ ]*", 0))
        return F.struct(*[p.alias(f) for p, (f, _, _) in zip(parts, fields)])

    def dealt(i, fields):
        return F.transform(F.filter("s", lambda x, p: p % len(sections) == i), lambda s: item(s, fields))

    groups: dict[str, list] = {}
    for i, (group, section, _, _, _, fields) in enumerate(sections):
        groups.setdefault(group, []).append(dealt(i, fields).alias(section))
    body = F.struct(*[F.struct(*parts).alias(g) for g, parts in groups.items()])
    return (read_table(spark, sf, "documents").select("doc_id", sentences.alias("s"))
            .select(F.col("doc_id").alias("report_id"), F.to_json(body).alias("report")))


@query
def g3_report_completeness(spark, sf):
    return (completeness.report_warnings(_reports(spark, sf))
            .groupBy("report_id", "section", F.coalesce("field", F.lit("-")).alias("field"))
            .agg(F.count(F.lit(1)).alias("warnings"), F.min("message").alias("first_message")))


@query
def g4_scenarios(spark, sf):
    return rounded(scenarios.apply_scenarios(
        _forecast(spark, sf), scenarios.lever_range_scenarios()).drop("method"), 2, factor=6)


# --- sort and limit ----------------------------------------------------------------------

@query
def h1_sorted_points(spark, sf):
    return rounded(D.sorted_points(_points(spark, sf)).select("series_id", "month", "type", "revenue", "bookings"), 2)


@query
def h2_top_categories(spark, sf):
    leads = _leads(spark, sf).withColumn("period", F.date_format("inquiry_date", "yyyy-MM"))
    return ST.top_categories(leads, "period")


@query
def h2_top_destinations(spark, sf):
    return ST.top_categories(_leads(spark, sf), "destination")


@query
def h3_last_months(spark, sf):
    return rounded(S.last_months(_history(spark, sf), 6))


@query
def h4_first_forecast_months(spark, sf):
    return rounded(S.first_months(_forecast(spark, sf).select("series_id", "month", "forecast"), 3), 2)


# --- streaming ---------------------------------------------------------------------------

@query
def k1_stream_monthly_revenue(spark, sf):
    """Two uploads: all leads at twice their price, then those inquired since 2000 as they are, columns reversed."""
    landing = scratch_path(spark, "landing")
    leads = _leads(spark, sf)
    csv_leads.write_leads_csv(leads.withColumn("trip_price", F.col("trip_price") * 2),
                              f"{landing}/leads_20010701_080000")
    csv_leads.write_leads_csv(leads.filter(F.col("inquiry_date") >= as_date("2000-01-01")).select(*reversed(leads.columns)),
                              f"{landing}/leads_20010801_080000")
    return rounded(stream_monthly_revenue(spark, f"{landing}/*", scratch_path(spark, "lead-state"),
                                          scratch_path(spark, "stream-state"), KEYS, AS_OF, buckets=16))
