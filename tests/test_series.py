from datetime import date

import pytest
from pyspark.sql import functions as F

from foresail.operators import leads as B, series as S


def revenues(df):
    return [r["revenue"] for r in df.orderBy("month").collect()]


def test_calendar_gap_becomes_zero_rows(spark):
    gap = spark.createDataFrame([("A", date(2020, 1, 1), 5.0, 1), ("A", date(2020, 4, 1), 7.0, 2),
                                 ("B", date(2020, 2, 1), 1.0, 1)],
                                "series_id string, month date, revenue double, trip_count long")
    rows = {(r.series_id, r.month): (r.revenue, r.trip_count) for r in S.fill_missing_months(gap).collect()}
    assert rows == {("A", date(2020, 1, 1)): (5.0, 1), ("A", date(2020, 2, 1)): (0.0, 0),
                    ("A", date(2020, 3, 1)): (0.0, 0), ("A", date(2020, 4, 1)): (7.0, 2),
                    ("B", date(2020, 2, 1)): (1.0, 1)}


def test_trailing_mean_skips_empty_months(make_series):
    series = make_series([1, 2, 3, 4, 5, 6, 7, 0], [1, 2, 3, 4, 5, 6, 7, 0])
    row = S.trailing_nonzero_mean(series).first()
    assert row.mean_trips == pytest.approx(4.5) and row.mean_revenue == pytest.approx(4.5)


def test_only_the_unbroken_flagged_run_is_removed(make_series):
    # flagged, complete, flagged: only the last one goes
    series = make_series([9000] * 8 + [10, 9000, 10])
    assert revenues(S.trim_incomplete_tail(S.flag_incomplete_months(series))) == [9000] * 8 + [10, 9000]


def test_all_four_checked_months_flagged(make_series):
    series = make_series([90000] * 8 + [10] * 4, [100] * 8 + [90] * 4)
    assert revenues(S.trim_incomplete_tail(S.flag_incomplete_months(series))) == [90000] * 8


def test_five_low_months_lose_only_the_checked_four(make_series):
    series = make_series([900000] * 8 + [500] * 5, [100] * 13)
    assert revenues(S.trim_incomplete_tail(S.flag_incomplete_months(series))) == [900000] * 8 + [500]


def test_two_months_are_never_flagged(make_series):
    assert not S.flag_incomplete_months(make_series([5000, 1])).filter("incomplete").count()


def test_short_series_with_every_month_flagged_vanishes(make_series):
    assert S.trim_incomplete_tail(S.flag_incomplete_months(make_series([10, 10, 10]))).count() == 0


@pytest.mark.parametrize("last, kept", [(1900, False), (2100, True), (0, True)])
def test_collapsed_last_month(make_series, last, kept):
    out = revenues(S.drop_collapsed_last_month(make_series([10000, 10000, last])))
    assert out == [10000, 10000] + ([last] if kept else [])


@pytest.mark.parametrize("history, kept", [([10000] * 5 + [2900], False), ([10000] * 5 + [3100], True),
                                           ([2000, 999], False), ([999], True), ([0, 0, 500], False)])
def test_anomalous_last_month(make_series, history, kept):
    out = revenues(S.drop_anomalous_last_month(make_series(history)))
    assert out == (history if kept else history[:-1])


def test_anomaly_looks_at_twelve_months_only(make_series):
    history = [10 ** 9] + [10000] * 12 + [4000]
    assert revenues(S.drop_anomalous_last_month(make_series(history))) == history


def test_profile_leaves_a_low_last_month_out(make_series):
    row = S.series_profile(make_series([100.0, 200.0, 300.0, 20.0])).first()
    assert row.recent_mean_12 == pytest.approx(200) and row.plain_mean_12 == pytest.approx(155)
    assert row.recent_std_12 == pytest.approx(100) and row.last_revenue == 20


def test_one_row_profile_has_no_deviation(make_series):
    row = S.series_profile(make_series([100.0])).first()
    assert row.recent_std_12 is None and row.hist_std is None and row.recent_mean_6 == 100


@pytest.mark.parametrize("history, logistic", [
    ([1, 2], False), ([10, 20, 30, 40, 50, 60, 70], False), ([10, 20, 30, 40, 50, 60, 70, 70, 70, 70, 70, 70], True),
    ([100, 90, 80], True)])  # falling as fast as overall is below half of it: the rule saturates
def test_growth_mode(make_series, history, logistic):
    row = S.growth_mode(make_series(history)).first()
    assert row.logistic is logistic
    if logistic:
        assert row.cap == pytest.approx(max(max(history[-6:]) * 1.5, max(history) * 1.2))


def test_monthly_revenue_keys_add_up_to_all(make_leads):
    done = {"current_stage": "completed", "trip_price": 10.1}
    leads = make_leads([{**done, "destination": d, "trip_date": t} for d in ("X", "Y", None, "ALL")
                        for t in ("2020-01-05", "2020-01-31", "2020-02-01")]
                       + [{**done, "destination": "X", "trip_date": None},
                          {"current_stage": "lost", "destination": "X", "trip_date": "2020-01-01"}])
    rows = {(r.series_id, r.month.month): (r.revenue, r.trip_count)
            for r in S.monthly_revenue(leads, ["destination"], "2020-01-31").collect()}
    assert rows == {("ALL", 1): (80.8, 8), ("X", 1): (20.2, 2), ("Y", 1): (20.2, 2), ("destination=ALL", 1): (20.2, 2)}


def test_several_keys_label_their_series(make_leads):
    leads = make_leads([{"current_stage": "completed", "destination": "X", "lead_source": "W", "trip_price": 1.0,
                         "trip_date": "2020-01-05"}])
    ids = {r.series_id for r in S.monthly_revenue(leads, ["destination", "lead_source"]).collect()}
    assert ids == {"ALL", "destination=X|lead_source=W"}


def test_completed_trip_after_the_date_becomes_final_payment(make_leads):
    leads = make_leads([{"current_stage": "completed", "trip_date": "2020-06-02"},
                        {"current_stage": "completed", "trip_date": "2020-06-01"},
                        {"current_stage": "inquiry", "inquiry_date": "2020-06-01"},
                        {"current_stage": "inquiry", "inquiry_date": "2020-06-02"},
                        {"current_stage": "lost", "inquiry_date": "2020-01-01"},
                        {"current_stage": "inquiry"}])
    out = {r.lead_id: r.current_stage for r in B.open_leads(leads, "2020-06-01").collect()}
    assert out == {"L0": "final_payment", "L2": "inquiry"}


def test_features_of_unknown_dates_are_zero(make_leads):
    row = B.lead_features(make_leads([{}])).first()
    assert (row.inquiry_month, row.inquiry_quarter, row.is_peak_season, row.duration_days) == (0, 0, 0, 0)
    row = B.lead_features(make_leads([{"inquiry_date": "2020-10-03"}])).first()
    assert (row.inquiry_month, row.inquiry_quarter, row.inquiry_year, row.is_peak_season) == (10, 4, 2020, 1)


def test_trimming_only_removes_a_suffix(spark, make_series):
    import random
    rng = random.Random(7)
    for n in range(1, 12):
        history = [rng.choice([0, 500, 20000, 90000]) for _ in range(n)]
        out = revenues(S.trimmed_series(make_series(history, [rng.choice([1, 10, 20]) for _ in history])))
        assert out == [float(x) for x in history[:len(out)]]


def test_first_and_last_months(make_series):
    s = make_series([1, 2, 3, 4])
    assert revenues(S.last_months(s, 2)) == [3, 4] and revenues(S.first_months(s, 2)) == [1, 2]


def test_monthly_revenue_sums_exactly(spark, make_leads):
    leads = make_leads([{"current_stage": "completed", "trip_price": 0.1, "trip_date": "2020-01-05"}] * 1000)
    assert S.monthly_revenue(leads.withColumn("lead_id", F.lit("x"))).first().revenue == 100.0
