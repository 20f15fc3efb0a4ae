import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresail.operators import forecasts as P, series as S
from foresail.plans import forecast as FC, trend as T
from foresail.schema import SEED42_NORMALS


def values(df, column="forecast"):
    return [r[column] for r in df.orderBy("month").collect()]


def with_last(forecast, last, **more):
    cols = {"last_revenue": last, "recent_std_12": 10.0, "recent_mean_6": 100.0, "hist_mean": 100.0, "hist_std": 20.0,
            "hist_max": 150.0, "plain_mean_6": 100.0, **more}
    return forecast.withColumns({c: F.lit(v).cast("double") for c, v in cols.items()})


def test_no_blend_below_a_rise_of_30_percent(make_forecast):
    rows = with_last(make_forecast([129.0, 200, 200, 200]), 100.0)
    assert values(P.transition_blend(rows)) == [129, 200, 200, 200]


def test_blend_above_it(make_forecast):
    out = P.transition_blend(with_last(make_forecast([131.0, 200, 200, 200]), 100.0))
    assert values(out) == pytest.approx([0.2 * 131 + 80, 0.4 * 200 + 60, 0.6 * 200 + 40, 200])
    assert values(out, "lower")[3] == pytest.approx(140) and values(out, "upper")[3] == pytest.approx(260)


@pytest.mark.parametrize("last", [0.0, -5.0])
def test_blend_when_the_last_month_is_not_positive(make_forecast, last):
    assert values(P.transition_blend(with_last(make_forecast([10.0, 10, 10]), last)))[0] == pytest.approx(2 + 0.8 * last)


def test_series_without_history_pass_unchanged(make_forecast):
    rows = with_last(make_forecast([10.0, 400.0]), None, recent_mean_6=None, recent_std_12=None, hist_mean=None,
                     hist_std=None, hist_max=None, plain_mean_6=None)
    for op in (P.transition_blend, P.ensemble_variation, P.component_variation, P.cap_to_history, P.dampen_start,
               P.interval_rebuild):
        assert values(op(rows)) == [10, 400]


def test_smoothing_matches_the_recursion(make_forecast):
    x = [10.0, 20, 5, 80, 3, 3, 9]
    y = [x[0]]
    for v in x[1:]:
        y.append(0.7 * v + 0.3 * y[-1])
    assert values(P.ewm_smooth(make_forecast(x)), "smoothed") == pytest.approx(y)


def test_variation_uses_the_seeded_draws(make_forecast):
    state = np.random.RandomState(42)
    assert list(SEED42_NORMALS) == pytest.approx(list(state.normal(0, 1, 12)))
    rows = with_last(make_forecast([100.0] * 12), 100.0, hist_std=60.0, recent_std_12=60.0)
    component = np.clip(1 + 0.5 * 0.6 * np.array(SEED42_NORMALS), 0.7, 1.3) * 100
    ensemble = 100 * (1 + np.clip(0.4 * 0.6 * np.array(SEED42_NORMALS), -0.25, 0.25))
    assert values(P.component_variation(rows)) == pytest.approx(list(component))
    assert values(P.ensemble_variation(rows)) == pytest.approx(list(ensemble))


def test_dampening(make_forecast):
    out = P.dampen_start(with_last(make_forecast([200.0, 200, 200]), 100.0))
    assert values(out) == pytest.approx([200 * d + 100 * (1 - d) for d in (0.7, 0.8, 0.9)])
    assert values(P.dampen_start(with_last(make_forecast([130.0, 500]), 100.0))) == [130, 500]


def test_caps(make_forecast):
    assert values(P.cap_outliers(make_forecast([1.0, 1, 1, 50]))) == [1, 1, 1, 3]
    assert values(P.cap_outliers(make_forecast([50.0]))) == [50]
    assert values(P.cap_outliers(make_forecast([0.0, 0, 50]))) == [0, 0, 50]
    out = P.cap_to_history(with_last(make_forecast([10.0, 900], upper=[20, 2000]), 100.0))
    assert values(out) == [10, 225] and values(out, "upper") == [20, 337.5]
    untouched = P.cap_to_history(with_last(make_forecast([10.0, 200], upper=[20, 2000]), 100.0))
    assert values(untouched, "upper") == [20, 2000]


def test_interval(make_forecast):
    out = P.interval_rebuild(with_last(make_forecast([100.0, 100]), 100.0, recent_std_12=150.0))
    assert values(out, "lower") == [0, 0] and values(out, "upper") == [250, 250]


def component(make_forecast, vals, method, start=(2021, 1)):
    return make_forecast(vals, start=start).withColumn("method", F.lit(method))


def test_weights_are_renormalised_when_a_component_is_missing(make_forecast):
    two = component(make_forecast, [100.0], "seasonal").unionByName(component(make_forecast, [200.0], "rules"))
    assert values(P.combine(two)) == pytest.approx([(40 + 60) / 0.7])
    three = two.unionByName(component(make_forecast, [300.0], "scored"))
    assert values(P.combine(three)) == pytest.approx([40 + 60 + 90])
    odd = two.unionByName(component(make_forecast, [600.0], "other"))
    assert values(P.combine(odd)) == pytest.approx([(40 + 60 + 200) / (0.7 + 1 / 3)])


def test_months_a_component_lacks_count_as_zero(make_forecast):
    late = component(make_forecast, [200.0, 200], "rules", (2021, 2))
    two = component(make_forecast, [100.0, 100], "seasonal").unionByName(late)
    assert values(P.combine(two)) == pytest.approx([40 / 0.7, 100 / 0.7, 60 / 0.7])


def reference_fit(y):
    """Linear trend plus centred calendar-month residual means, by hand."""
    n = len(y)
    t = list(range(n))
    b = np.polyfit(t, y, 1)[0] if n > 1 else 0.0
    a = statistics.mean(y) - b * statistics.mean(t)
    r = [v - a - b * i for i, v in enumerate(y)]
    effect = {m: statistics.mean(r[m::12]) for m in range(min(12, n))}
    centre = statistics.mean(effect.values())
    season = {m: e - centre for m, e in effect.items()}
    left = [v - season[i % 12] for i, v in enumerate(r)]
    sigma = statistics.stdev(left) if n > 1 else 0.0
    return [a + b * (n + h) + season.get((n + h) % 12, 0.0) for h in range(12)], sigma


@pytest.mark.parametrize("n", [1, 2, 7, 30])
def test_linear_trend_against_a_hand_fit(make_series, n):
    y = [1000.0 + 20 * i + 100 * math.sin(i) for i in range(n)]
    want, sigma = reference_fit(y)
    raw = T.predict_seasonal_trend(T.fit_seasonal_trend(make_series(y), growth="linear")).orderBy("month").collect()
    assert [r.forecast for r in raw] == pytest.approx(want)
    assert [r.upper - r.forecast for r in raw] == pytest.approx([1.2816 * sigma] * 12, abs=1e-6)


def test_logistic_trend_stays_below_its_cap(make_series):
    y = [10000.0 + 2000 * min(i, 20) for i in range(40)]
    model = T.fit_seasonal_trend(make_series(y)).first()
    assert model.logistic and model.cap == pytest.approx(75000)
    assert all(v < model.cap + max(model.seasonal.values()) for v in values(T.predict_seasonal_trend(
        T.fit_seasonal_trend(make_series(y)))))


def test_backtest_cutoffs_and_scores(make_series):
    series = make_series([100.0 + i for i in range(12)])
    rows = T.rolling_origin(series).collect()
    # cutoffs: months 7..9 (six months after the first, three before the last)
    assert sorted({r.cutoff.month for r in rows}) == [7, 8, 9] and len(rows) == 9
    assert T.rolling_origin(make_series([1.0] * 9)).count() == 0
    got = T.backtest_metrics(T.rolling_origin(series)).first()
    by_step = T.backtest_by_horizon(T.rolling_origin(series)).collect()
    assert got.mae == pytest.approx(statistics.mean(r.mae for r in by_step))


def test_seasonal_model_beats_last_year_on_a_seasonal_series(make_series):
    """Same cutoffs, so that the comparison with the same-month-last-year yardstick is fair."""
    rng = np.random.RandomState(3)
    y = [50000 + 300 * i + 15000 * math.sin(2 * math.pi * i / 12) + rng.normal(0, 3000) for i in range(72)]
    series = make_series(y)
    naive = T.same_month_last_year(series).filter("cutoff >= '2023-01-01'")
    model = T.rolling_origin(series).filter("cutoff >= '2023-01-01'")
    assert T.backtest_metrics(model).first().mae <= T.backtest_metrics(naive).first().mae


def history_leads(make_leads, months=24):
    rows = []
    for i in range(months):
        y, m = 2019 + i // 12, i % 12 + 1
        for d in ("X", "Y"):
            rows += [{"current_stage": "completed", "trip_price": 20000.0 + 100 * i, "destination": d,
                      "lead_source": "W", "is_repeat_customer": 0, "inquiry_date": f"{y}-{m:02d}-01",
                      "quote_date": f"{y}-{m:02d}-02", "booking_date": f"{y}-{m:02d}-03",
                      "final_payment_date": f"{y}-{m:02d}-04", "trip_date": f"{y}-{m:02d}-10"}] * 3
    return rows


def test_forecast_end_to_end(make_leads):
    rows = history_leads(make_leads)
    rows += [{"current_stage": "booked", "trip_price": 50000.0, "destination": d, "lead_source": "W",
              "is_repeat_customer": 0, "inquiry_date": "2020-12-01"} for d in ("X", "New")]
    out = FC.forecast_12_months(make_leads(rows), "2020-12-31", ["destination"])
    got = {}
    for r in out.collect():
        got.setdefault(r.series_id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {"ALL": 12, "X": 12, "Y": 12, "New": 12}
    assert {min(r.month for r in v).isoformat() for k, v in got.items() if k != "New"} == {"2021-01-01"}
    assert min(r.month for r in got["New"]).isoformat() == "2020-12-01"     # no history: starts at the date given
    for r in out.collect():
        assert 0 <= r.lower <= r.forecast <= r.upper and r.method == "ensemble"


def test_cube_route_equals_the_direct_route(spark, make_leads):
    from foresail.operators import leads as B, rates as R
    leads = make_leads(history_leads(make_leads, 5) + [
        {"current_stage": s, "trip_price": 1000.0, "destination": "X", "lead_source": src, "is_repeat_customer": rep,
         "inquiry_date": "2019-02-01"} for s in ("inquiry", "quote_sent", "lost", "booked") for src in ("W", None)
        for rep in (0, 1, None)])
    cube = FC.lead_cube(leads, ["destination"], "2019-04-15")

    def rows(df):
        return sorted(map(str, df.select(*sorted(df.columns)).collect()))

    assert rows(FC.cube_monthly(cube, ["destination"])) == rows(S.monthly_revenue(leads, ["destination"], "2019-04-15"))
    assert rows(FC.cube_rates(cube)) == rows(R.conversion_rates(leads))
    assert rows(FC.cube_open_value(cube, ["destination"])) == rows(
        R.open_value(B.open_leads(leads, "2019-04-15"), ["destination"]))


def test_forecast_needs_a_component(make_leads):
    with pytest.raises(ValueError):
        FC.forecast_12_months(make_leads([{}]), "2020-01-01", use_seasonal=False, use_rules=False)


def test_loaded_rates_replace_learned_ones(spark, make_leads):
    from foresail.operators.rates import fallback_rates
    leads = make_leads(history_leads(make_leads) + [{"current_stage": "booked", "trip_price": 120000.0,
                                                    "inquiry_date": "2020-12-01", "destination": "X"}])
    out = FC.forecast_12_months(leads, "2020-12-31", rates=fallback_rates(spark), use_seasonal=False)
    assert out.count() == 12


def test_a_bend_beats_the_straight_line(spark, make_series):
    rng = np.random.default_rng(3)
    t = np.arange(60)
    kinked = 1000 + 20 * t - 45 * np.maximum(t - 30, 0) + rng.normal(0, 15, 60) + 1000
    straight = 5000 + 30 * t + rng.normal(0, 40, 60)
    both = make_series(kinked.tolist(), series_id="kinked").unionByName(make_series(straight.tolist(), series_id="straight"))
    model = {r.series_id: r for r in T.fit_seasonal_trend(both, growth="linear", changes=True).collect()}
    assert abs(model["kinked"].kink - 30) <= 2 and model["kinked"].bend == pytest.approx(-45, abs=3)
    assert (model["straight"].kink, model["straight"].bend) == (0, 0.0)
    # the same by least squares at every place
    best = {}
    for kink in sorted({4 * 60 * k // 125 for k in range(1, 25)}):
        x = np.column_stack([np.ones(60), t, np.maximum(t - kink, 0)])
        beta, *_ = np.linalg.lstsq(x, kinked, rcond=None)
        best[kink] = (((kinked - x @ beta) ** 2).sum(), beta)
    kink = min(best, key=lambda k: best[k][0])
    row = model["kinked"]
    assert row.kink == kink and (row.intercept, row.slope, row.bend) == pytest.approx(tuple(best[kink][1]))
    error = {c: T.backtest_metrics(T.rolling_origin(both, changes=c).filter("series_id = 'kinked' and cutoff >= '2023-01-01'")).first().mae for c in (False, True)}
    assert error[True] < 0.5 * error[False]
    assert T.fit_seasonal_trend(make_series([1.0] * 20), changes=True).first().bend == 0.0
    assert T.fit_seasonal_trend(make_series([1.0, 2.0]), changes=True).first().bend == 0.0
