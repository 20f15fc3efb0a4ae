from datetime import date

import json
import pytest
from pyspark.sql import functions as F

from foresail.operators import completeness, insights as G, reporting as D, scenarios
from foresail.schema import LEAD_COLUMNS
from foresail.sources import csv_leads, sinks
from foresail.sources.snapshots import SnapshotStore
from foresail.streaming.uploads import append_uploads, current_leads, current_revenue, stream_monthly_revenue
from foresail.operators.series import monthly_revenue

HEADER = ",".join(LEAD_COLUMNS)
ROW = "{i},2023-01-15,Europe,{price},Referral,{stage},0,2023-01-18,2023-02-01,{trip},2023-06-15,14"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_with_comments_blank_and_empty_rows(spark, tmp_path):
    path = write(tmp_path / "l.csv", "", "# top", HEADER, ROW.format(i="A", price="4500", stage="completed", trip="2023-07-15"),
                 "   # indented", "   ", "," * 11, "B,2023-13-40,,abc,Web,lost,,,,  ,,", "# end")
    got = {r.lead_id: r for r in csv_leads.read_leads_csv(spark, path).collect()}
    assert set(got) == {"A", "B"}
    assert got["A"].trip_date == date(2023, 7, 15) and got["A"].trip_price == 4500.0 and got["A"].duration_days == 14
    assert got["B"].inquiry_date is None and got["B"].trip_price is None and got["B"].destination is None
    assert got["B"].trip_date is None and got["B"].is_repeat_customer is None


def test_csv_column_order_quotes_and_optional_columns(spark, tmp_path):
    path = write(tmp_path / "l.csv", "current_stage,lead_id,inquiry_date,trip_price,trip_date,booking_date,destination",
                 'lost,A,2023-01-01,1.5,,,"Oslo, Bergen"')
    row = csv_leads.read_leads_csv(spark, path).first()
    assert row.destination == "Oslo, Bergen" and row.lead_source is None and row.current_stage == "lost"


def test_missing_columns_are_named(spark, tmp_path):
    path = write(tmp_path / "l.csv", "lead_id,inquiry_date,trip_price,current_stage", "A,2023-01-01,1,lost")
    with pytest.raises(ValueError, match="trip_date.*booking_date"):
        csv_leads.read_leads_csv(spark, path)


def points(spark):
    rows = [("ALL", date(2024, m, 1), r, b, "historical", None, None)
            for m, (r, b) in enumerate([(85000., 42), (92000., 48), (78000., 39), (105000., 55), (115000., 62), (98000., 51)], 1)]
    rows += [("ALL", date(2024, m, 1), r, None, "forecast", r - 1000, r + 1000)
             for m, r in enumerate([120000., 135000., 125000., 140000., 150000., 165000.], 7)]
    return spark.createDataFrame(rows, "series_id string, month date, revenue double, bookings long, type string, lower double, upper double")


def test_kpis_growth_and_chart(spark):
    p = points(spark)
    k = D.horizon_kpis(p).first()
    mean = (85000 + 92000 + 78000 + 105000 + 115000 + 98000) / 6
    assert (k.total_forecast, k.forecast_1mo, k.forecast_3mo, k.forecast_6mo) == (835000, 120000, 380000, 835000)
    assert k.avg_12mo == pytest.approx(835000 / 12) and k.diff == 0 and k.diff_pct == 0
    assert k.compare_3mo == pytest.approx((380000 / 3 - mean) / mean * 100)
    g = D.executive_growth(p).first()
    assert g.growth_pct == pytest.approx((835000 - 573000) / 573000 * 100)
    c = D.chart_rows(p).orderBy("month").collect()
    assert c[0].prev_revenue is None and c[6].prev_revenue == 98000 and c[6].confidence_band == [119000, 121000]
    assert {r.transition_index for r in c} == {5} and c[5].revenue_forecast is None and c[6].half_width == 1000
    assert D.filter_series(p, True, "2024-08-01", "2024-10-01").count() == 3
    assert [r.month.month for r in D.sorted_points(p.orderBy(F.rand(1))).collect()] == list(range(1, 13))


def test_kpis_without_history(spark):
    k = D.horizon_kpis(points(spark).filter("type = 'forecast'")).first()
    assert k.historical_mean == 0 and k.compare_1mo == 0


def test_forecast_classes(make_forecast):
    f = make_forecast([100.0, 100, 100, 100, 0, 150, 150, 150, 150, 106, 106, 106])
    assert D.trend_class(f).first().trend == "INCREASING"
    assert D.trend_class(make_forecast([100.0] * 3 + [94.0] * 3)).first().trend == "DECREASING"
    assert D.trend_class(make_forecast([100.0] * 3 + [105.0] * 3)).first().trend == "STABLE"
    assert D.volatility_class(f).first().volatility == "HIGH" and D.volatility_class(make_forecast([1.0])).count() == 0
    pt = D.peak_trough(f).first()
    assert (pt.peak_month, pt.trough_month) == (date(2021, 6, 1), date(2021, 5, 1))
    q = {r.quarter: r for r in D.quarterly_forecast(f).collect()}
    assert q[1].average == 100 and q[4].q1_to_q4_pct == pytest.approx(6.0)
    short = {r.quarter: r for r in D.quarterly_forecast(make_forecast([1.0, 2, 3, 4])).collect()}
    assert short[2].average == 4 and short[1].q1_to_q4_pct is None
    m = D.month_over_month(f).orderBy("month").collect()
    assert m[0].mom_pct is None and m[5].mom_pct == 0 and m[4].mom_pct == -100 and m[0].mom_label == " (Baseline)"
    v = D.deviation_from_mean(make_forecast([1.0, 3, 2])).orderBy("month").collect()
    assert [r.vs_mean for r in v] == ["BELOW AVG", "ABOVE AVG", "AT AVG"] and v[1].deviation_pct == 50


def test_exports(spark, tmp_path):
    rows = sinks.export_rows(points(spark)).orderBy("month").collect()
    assert (rows[0].Date, rows[0].Revenue, rows[0].Type, rows[0].Bookings) == ("Jan 2024", "$85,000", "Historical", "42")
    sinks.export_series_csv(points(spark), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0] == "series_id,Date,Revenue,Type,Bookings" and lines[1] == '"ALL","Jan 2024","$85,000","Historical","42"'
    assert lines[-1] == '"ALL","Dec 2024","$165,000","Forecast",""'
    records = [json.loads(r.record) for r in sinks.forecast_json(
        points(spark).filter("type = 'forecast'").withColumnRenamed("revenue", "forecast")).collect()]
    assert records[0] == {"date": "2024-07-01", "forecast": 120000.0, "lower": 119000.0, "upper": 121000.0}


def test_many_series_share_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SERIES_PER_FILE", 10)
    names = [f'say "{k}",\n{k}' for k in range(35)]
    some = spark.createDataFrame([(n,) for n in names], "series_id string").crossJoin(points(spark).drop("series_id")).repartition(9)
    path = tmp_path / "out"
    sinks.export_series_csv(some, str(path))
    files = list(path.glob("part-*"))
    assert len(files) <= 4 and all(f.read_text().startswith("series_id,Date,") for f in files)
    back = sinks.read_series_csv(spark, str(path)).collect()
    want = sinks.export_rows(some).collect()
    assert sorted((r.series_id, r.Date, r.Revenue, r.Type, r.Bookings or "") for r in back) == sorted((r.series_id, r.Date, r.Revenue, r.Type, r.Bookings or "") for r in want)
    sinks.write_forecast_json(some.withColumnRenamed("revenue", "forecast"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 35 * 12 and len(list((tmp_path / "json").glob("part-*"))) <= 4


def test_a_saved_table_is_replaced_in_one_step(spark, tmp_path):
    from foresail.sources.artifacts import ArtifactStore
    store = ArtifactStore(spark, str(tmp_path))
    assert store.load_table("t") is None
    store.save_table("t", spark.range(3))
    before = store.load_table("t")
    store.save_table("t", before.withColumn("id", before.id + 10))  # may read what it replaces
    assert sorted(r.id for r in before.collect()) == [0, 1, 2]     # a reader of before still reads it
    assert sorted(r.id for r in store.load_table("t").collect()) == [10, 11, 12]
    spark.range(9).write.parquet(store._path("t", "halfway"))        # a save that died before its last step
    assert store.load_table("t").count() == 3


def test_short_history_is_refused(spark, make_leads):
    from foresail.plans.forecast import forecast_12_months
    leads = make_leads([{"current_stage": "completed", "trip_date": f"2023-0{m}-15", "inquiry_date": "2023-01-01", "trip_price": 10.0} for m in range(1, 7)])
    with pytest.raises(ValueError, match="0.41 years; 1.0 required"):
        forecast_12_months(leads, "2023-12-31", min_years=1.0)
    with pytest.raises(ValueError, match="0.00 years"):
        forecast_12_months(leads.limit(0), "2023-12-31", min_years=1.0)
    assert forecast_12_months(leads, "2023-12-31", min_years=0.25).count() == 12


def test_snapshots(spark, make_forecast, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.newest_first().count() == 0
    old = store.save(make_forecast([1.0, 2]), "old", "ana", "2024-01-01 00:00:00")
    new = store.save(make_forecast([3.0]), "new", "bo", "2024-02-01 00:00:00")
    assert [r.id for r in store.newest_first().collect()] == [new, old]
    assert not store.delete(old, "analyst") and store.visible().count() == 2
    assert store.delete(old, "admin") and [r.name for r in store.visible().collect()] == ["new"]
    assert [p.forecast for p in store.newest_first().first().data] == [3.0]


def test_masking(spark):
    r = spark.createDataFrame([(["a"], ["b"], 1)], "insights array<string>, key_drivers array<string>, x int")
    assert D.mask_for_role(r, "admin").first().insights == ["a"]
    hidden = D.mask_for_role(r, "analyst").first()
    assert hidden.insights == [] and hidden.key_drivers == [] and hidden.x == 1


def test_sentences(make_leads, make_series):
    leads = make_leads([{"current_stage": "completed", "trip_price": 1000.0, "lead_source": "Web", "destination": "X"},
                        {"current_stage": "lost", "lead_source": "Web"}])
    stats = G.lead_statistics(leads, "2020-01-01")
    monthly = make_series([1.0]).groupBy("series_id").agg(F.lit(5000.0).alias("average_monthly"), F.lit(12).cast("long").alias("total_months"))
    metrics = monthly.select("series_id", F.lit(0.1).alias("mape"))
    said = G.insights(stats, monthly, metrics).first().insights
    assert len(said) == 5 and said[0].startswith("Strong conversion rate of 50.0%") and "$1,000" in said[1]
    drivers = G.key_drivers(stats).first().key_drivers
    assert drivers[0] == "Web is the primary lead source (2 leads)" and drivers[1].startswith("X is the most popular")
    silent = G.lead_statistics(make_leads([{"current_stage": "lost"}]), "2020-01-01")
    assert G.insights(silent, monthly.filter("false")).first().insights == list(G.DEFAULT_INSIGHTS)
    assert G.key_drivers(silent).first().key_drivers == list(G.DEFAULT_DRIVERS)
    only_mape = G.insights(silent, monthly.filter("false"), metrics).first().insights
    assert only_mape == ["Seasonal model shows strong accuracy with MAPE of 10.0%."]


def full_report():
    long = "a text that is certainly long enough"
    return {"driving_factors": {s: [{"factor": long, "impact": long, "evidence": long}] * 3
                                for s in ("positive_factors", "negative_factors")},
            "operational_recommendations": {
                "immediate_actions": [{"action": long, "rationale": long, "expected_impact": long}] * 3,
                "strategic_initiatives": [{"initiative": long, "rationale": long, "expected_impact": long}] * 2,
                "risk_mitigation": [{"risk": long, "mitigation": long}] * 2,
                "optimization_opportunities": [{"opportunity": long, "description": long}] * 2},
            "executive_summary": {"key_insights": ["x"] * 3}}


def test_report_completeness(spark):
    short = full_report()
    short["driving_factors"]["positive_factors"][0] = {"factor": "too short", "impact": None, "evidence": "0123456789"}
    short["operational_recommendations"]["risk_mitigation"] = [{"risk": "x" * 19}]
    docs = spark.createDataFrame([("good", json.dumps(full_report())), ("short", json.dumps(short)), ("broken", "not json")],
                                 "report_id string, report string")
    got = {}
    for r in completeness.report_warnings(docs).orderBy("report_id", "warning_no").collect():
        got.setdefault(r.report_id, []).append(r.message)
    assert "good" not in got
    assert got["short"] == ["Positive factor 1 has incomplete 'factor' description",
                            "Positive factor 1 has incomplete 'impact' description",
                            "Insufficient risk mitigations: 1 (minimum 2 required)",
                            "Risk mitigation 1 has incomplete 'risk' description (too short or empty)",
                            "Risk mitigation 1 has incomplete 'mitigation' description (too short or empty)"]
    assert len(got["broken"]) == 7 and got["broken"][0] == "Insufficient positive factors: 0 (minimum 3 required)"


def test_scenarios(spark, make_forecast):
    out = {r.scenario: r for r in scenarios.apply_scenarios(
        make_forecast([100.0]), {"base": {}, "mix": {"Growth Rate": 10, "Seasonality": -99}}).collect()}
    assert out["base"].forecast == 100 and out["mix"].forecast == pytest.approx(100 * 1.1 * 0.85)
    assert scenarios.scenario_parameters(spark).count() == 5


def test_stream_keeps_the_newest_state_and_resumes(spark, tmp_path):
    landing, log, state = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "state")
    landing.mkdir()
    write(landing / "leads_20240101_080000.csv", "# first", HEADER, ROW.format(i="A", price=100, stage="booked", trip="2023-07-15"),
          ROW.format(i="B", price=200, stage="completed", trip="2023-07-20"))
    first = stream_monthly_revenue(spark, str(landing), log, state)
    assert [(r.revenue, r.trip_count) for r in first.collect()] == [(200.0, 1)]
    write(landing / "leads_20240301_080000.csv", HEADER, ROW.format(i="A", price=150, stage="completed", trip="2023-07-15"))
    write(landing / "leads_20240201_080000.csv", HEADER, ROW.format(i="A", price=999, stage="completed", trip="2023-07-15"))
    second = stream_monthly_revenue(spark, str(landing), log, state, max_files=1)
    assert [(r.revenue, r.trip_count) for r in second.collect()] == [(350.0, 2)]
    append_uploads(spark, str(landing), log, state)         # nothing new: nothing changes
    again = current_leads(spark, log)
    assert current_revenue(spark, log).collect() == second.collect()
    batch = csv_leads.read_leads_csv(spark, [str(landing / "leads_20240301_080000.csv")]).unionByName(
        csv_leads.read_leads_csv(spark, [str(landing / "leads_20240101_080000.csv")]).filter("lead_id = 'B'"))
    assert monthly_revenue(again).collect() == monthly_revenue(batch).collect()


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    from foresail.schema import LEAD_COLUMNS
    from foresail.sources.csv_leads import read_leads_csv
    cells = {c: "" for c in LEAD_COLUMNS} | {"lead_id": "L1", "destination": "Oslo", "trip_price": "10.5", "inquiry_date": "2024-01-02"}
    for name, order, ident in (("a.csv", list(LEAD_COLUMNS), "L1"), ("b.csv", list(LEAD_COLUMNS)[::-1], "L2")):
        row = cells | {"lead_id": ident}
        (tmp_path / name).write_text("\n".join(["# note", ",".join(order), ",".join(row[c] for c in order)]) + "\n")
    got = sorted((r.lead_id, r.destination, r.trip_price, str(r.inquiry_date)) for r in read_leads_csv(spark, str(tmp_path)).collect())
    assert got == [(i, "Oslo", 10.5, "2024-01-02") for i in ("L1", "L2")]
