import pytest
from pyspark.sql import functions as F

from foresail.operators import funnel as FN, rates as R, stats as ST


def lead(stage, source="W", repeat=0, **more):
    return {"current_stage": stage, "lead_source": source, "is_repeat_customer": repeat, "inquiry_date": "2020-01-01", **more}


def test_segment_of_19_uses_flat_rate_and_of_20_its_own(make_leads):
    rows = [lead("completed" if i < 10 else "lost", "small") for i in range(19)]
    rows += [lead("completed" if i < 5 else "lost", "large") for i in range(20)]
    leads = make_leads(rows)
    rates = R.conversion_rates(leads)
    asked = make_leads([lead("inquiry", "small"), lead("inquiry", "large"), lead("inquiry", "large", None),
                        lead("lost", "large"), lead("inquiry", None)])
    got = {r.lead_id: (r.conversion_rate, r.tier) for r in R.lookup_conversion_rate(asked, rates).collect()}
    flat = 15 / 39
    assert got["L0"] == (pytest.approx(flat), "flat") and got["L1"] == (0.25, "segmented")
    assert got["L2"] == (pytest.approx(flat), "flat") and got["L3"] == (0.0, "missing")
    assert got["L4"] == (pytest.approx(flat), "flat")
    kept = {(r.stage, r.lead_source): r for r in rates.filter("not is_flat").collect()}
    assert kept[("inquiry", "small")].rate is None and kept[("inquiry", "small")].total == 19
    summary = R.conversion_summary(rates).first()
    assert (summary.kept_segments, summary.total_segments, summary.min_segment_size) == (1, len(kept), 20)


def test_rate_rule_per_stage(make_leads):
    leads = make_leads([lead("completed", quote_date="2020-01-02"), lead("completed"), lead("booked"),
                        lead("lost", quote_date="2020-01-02")])
    got = {r.stage: (r.completed, r.total, r.rate) for r in R.flat_conversion_rates(leads).collect()}
    assert got["inquiry"] == (2, 4, 0.5)
    assert got["quote_sent"] == (1, 3, pytest.approx(1 / 3))      # the lost, quoted lead does not count
    assert got["booked"] == (0, 3, 0.0) and got["final_payment"] == (0, 2, 0.0)


def test_rate_of_an_empty_stage_is_zero(make_leads):
    got = {r.stage: r for r in R.flat_conversion_rates(make_leads([lead("lost")])).collect()}
    assert got["final_payment"].total == 0 and got["final_payment"].rate == 0.0


def test_fallback_rates_serve_the_lookup(spark, make_leads):
    got = R.lookup_conversion_rate(make_leads([lead("booked")]), R.fallback_rates(spark)).first()
    assert got.conversion_rate == 0.9 and got.tier == "flat"


def test_rule_totals_equal_row_by_row_sum(make_leads):
    leads = make_leads([lead("completed", trip_price=100.0, destination="X")] * 3
                       + [lead("inquiry", trip_price=200.0, destination="Y"), lead("booked", trip_price=50.0, destination="X")])
    rates = R.conversion_rates(leads)
    open_rows = leads.filter("current_stage in ('inquiry', 'booked')")
    by_row = R.lookup_conversion_rate(open_rows, rates).agg(F.sum(F.col("trip_price") * F.col("conversion_rate"))).first()[0]
    weighted = R.weighted_open_value(R.open_value(open_rows, ["destination"]), rates)
    totals = {r.series_id: r for r in R.rule_totals(weighted, ["destination"]).collect()}
    assert totals["ALL"].total == pytest.approx(by_row) and totals["ALL"].leads == 2
    assert totals["X"].total + totals["Y"].total == pytest.approx(by_row)


def test_cancelled_lead_with_trip_date_counts_as_reached(make_leads):
    leads = make_leads([lead("cancelled", trip_date="2020-05-01", trip_price=7.0)])
    got = {r.stage: r for r in FN.funnel_cohort(leads, "2020-01-01", "2020-01-31").collect()}
    assert got["completed"]["count"] == 1 and got["completed"].revenue_potential == 7.0 and got["booked"]["count"] == 0


def test_cohort_bounds_are_inclusive_and_empty_cohort_has_no_rows(make_leads):
    leads = make_leads([lead("inquiry")])
    assert FN.funnel_cohort(leads, "2020-01-01", "2020-01-01").count() == 5
    assert FN.funnel_cohort(leads, "2020-01-02", "2020-01-31").count() == 0


def test_step_rates(spark):
    rows = [(1, "inquiry", 8, 1.0), (2, "quote_sent", 0, 0.0), (3, "booked", 3, 2.0), (4, "final_payment", 1, 1.0)]
    rated = FN.funnel_rates(spark.createDataFrame(rows, "stage_no int, stage string, count long, revenue_potential double"))
    got = {r.stage: r for r in rated.collect()}
    assert got["inquiry"].conversion_rate is None and got["inquiry"].drop_off_rate is None
    assert (got["quote_sent"].conversion_rate, got["quote_sent"].drop_off_rate) == (0.0, 100.0)
    assert (got["booked"].conversion_rate, got["booked"].drop_off_rate) == (0.0, 100.0)   # previous stage is empty
    assert (got["final_payment"].conversion_rate, got["final_payment"].drop_off_rate) == (33.3, 66.7)
    assert got["booked"].color == "#8b5cf6" and got["booked"].avg_days_in_stage is None


def test_funnel_summary(spark):
    rows = [(i + 1, s, c, v) for i, (s, c, v) in enumerate([
        ("a", 10000, 5e5), ("b", 2500, 4e5), ("c", 1000, 3e5), ("d", 600, 1.8e5)])]
    got = FN.funnel_summary(spark.createDataFrame(rows, "stage_no int, stage string, count long, revenue_potential double")).first()
    assert got.total_count == 14100 and got.overall_pct == pytest.approx(6.0)
    assert got.mean_step_pct == pytest.approx((25 + 40 + 60) / 3) and got.total_potential == pytest.approx(1.38e6)


def test_visibility_and_order(make_leads):
    leads = make_leads([lead(s) for s in ("lost", "booked", "inquiry", "odd", "cancelled")])
    shown = FN.funnel_visibility(FN.stage_counts(leads)).collect()
    assert [(r.stage, r.stage_no) for r in shown] == [("inquiry", 1), ("booked", 3), ("odd", 999)]
    both = FN.funnel_visibility(FN.stage_counts(leads), True, True)
    assert [r.stage for r in both.collect()] == ["inquiry", "booked", "lost", "cancelled", "odd"]


def test_duplicates_count_nulls_as_equal(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a"), (None, None)], "a int, b string")
    assert ST.duplicate_records(rows).first()[0] == 2


def test_missing_values(make_leads):
    got = {r.column_name: r.missing for r in ST.missing_values(make_leads([lead("lost"), {}])).collect()}
    assert got["current_stage"] == 1 and got["trip_date"] == 2 and got["lead_id"] == 0


def test_history_span_strict_and_keyed(make_leads):
    leads = make_leads([{"current_stage": "completed", "trip_date": d, "destination": k} for d, k in (
        ("2023-07-15", "A"), ("2023-11-15", "A"), ("2020-01-01", "B"), ("2023-01-01", "B"))])
    got = {r.destination: r for r in ST.history_span(leads, by=["destination"]).collect()}
    assert got["A"].eligible is False and got["A"].years == pytest.approx(123 / 365.25) and got["B"].eligible is True
    assert ST.require_history(leads.filter("destination = 'B'")).first().checked is True
    with pytest.raises(Exception, match="completed history spans 0.34 years"):
        ST.require_history(leads.filter("destination = 'A'")).collect()
    with pytest.raises(Exception, match="no years"):
        ST.require_history(make_leads([lead("lost")])).collect()


def test_metadata_of_leads_without_completed_trips(make_leads):
    row = ST.load_metadata(make_leads([lead("lost"), lead("inquiry")])).first()
    assert (row.total_records, row.completed_trips, row.total_revenue, row.avg_trip_price, row.conversion_rate) == (2, 0, 0.0, 0.0, 0.0)


def test_top_category_breaks_ties_by_name(make_leads):
    assert ST.top_category(make_leads([lead("lost", "b"), lead("lost", "a"), {}]), "lead_source").first().top == "a"


def test_revenue_stats_without_completed_trips_has_no_row(make_leads):
    assert ST.revenue_stats(make_leads([lead("lost")])).count() == 0
