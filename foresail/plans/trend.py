"""Seasonal trend model in closed form, and its rolling-origin backtest.

Trend: least squares of revenue on the month number, or of its logit below a cap where recent
growth has stalled; with ``changes`` its slope may change once, where that pays. Season: mean residual of each calendar month, centred. Band: 80 % of the
remaining residuals' sample deviation. Fitting is window arithmetic over monthly rows under
one partitioning, so any number of series is fitted in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from foresail.functions.expr import clip, months_after
from foresail.operators.forecasts import cap_outliers
from foresail.operators.series import SERIES, growth_columns
from foresail.schema import HORIZON, Z_80
from foresail.session import settle


#: Places tried for a change of slope, evenly over the first four fifths of a series of a year or more, and
#: what a change has to gain: n ln(error before / error after) above so many times ln(n).
KNOTS, CHANGE_COST, CHANGE_MONTHS = 24, 3, 12


def slope_changes(points: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """(by, kink, bend, slope, intercept) of the series whose line (n, t, y) changes its slope.

    Normal equations of intercept, slope and bend per series and place, from sums of months; the place of
    least error counts, the earlier one of equals."""
    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(KNOTS)), lambda k: F.floor(4 * F.col("n") * k / (5 * (KNOTS + 1))).cast("int")))
    tried = points.filter(F.col("n") >= CHANGE_MONTHS).withColumn("kink", F.explode(places)).filter((F.col("kink") >= 1) & (F.col("kink") <= F.col("n") - 3))
    t, y, h = F.col("t").cast("double"), F.col("y"), F.greatest(F.col("t") - F.col("kink"), F.lit(0)).cast("double")
    total = {"st": t, "sy": y, "sh": h, "stt": t * t, "sty": t * y, "syy": y * y, "shh": h * h, "sth": t * h, "shy": h * y}
    sums = tried.groupBy(*by, "kink").agg(F.max("n").cast("double").alias("m"), *[F.sum(c).alias(k) for k, c in total.items()])

    def centred(ab: str, a: str, b: str):
        return F.col(ab) - F.col(a) * F.col(b) / F.col("m")

    sums = sums.withColumns({"tt": centred("stt", "st", "st"), "ty": centred("sty", "st", "sy"), "yy": centred("syy", "sy", "sy"),
                             "hh": centred("shh", "sh", "sh"), "th": centred("sth", "st", "sh"), "hy": centred("shy", "sh", "sy")})
    det = F.col("tt") * F.col("hh") - F.col("th") * F.col("th")
    sums = sums.withColumns({"bend": (F.col("tt") * F.col("hy") - F.col("th") * F.col("ty")) / det,
                             "slope": (F.col("hh") * F.col("ty") - F.col("th") * F.col("hy")) / det})
    nothing = F.col("yy") * 1e-9  # errors below this are none
    sums = sums.withColumns({"intercept": (F.col("sy") - F.col("slope") * F.col("st") - F.col("bend") * F.col("sh")) / F.col("m"),
                             "before": F.greatest(F.col("yy") - F.col("ty") * F.col("ty") / F.col("tt"), nothing),
                             "after": F.greatest(F.col("yy") - F.col("slope") * F.col("ty") - F.col("bend") * F.col("hy"), nothing)})
    best = sums.groupBy(*by).agg(F.min_by(F.struct("kink", "bend", "slope", "intercept", "before", "after", "m"), F.struct("after", "kink")).alias("b")).select(*by, "b.*")
    gain = F.col("m") * F.log(F.try_divide("before", "after"))
    return best.filter(gain > CHANGE_COST * F.log("m")).select(*by, "kink", "bend", "slope", "intercept")


def _line(t):
    """The model's straight or once bent line at month number ``t``."""
    return F.col("intercept") + F.col("slope") * t + F.col("bend") * F.greatest(t - F.col("kink"), F.lit(0))


def fit_seasonal_trend(series: DataFrame, by: Sequence[str] = SERIES, growth: str | None = None, changes: bool = False) -> DataFrame:
    """One model row per series: mode, cap, line with its bend, calendar-month effects and sigma.

    ``growth`` forces "linear" for all series; by default each series chooses. ``changes`` lets the slope
    change once (``slope_changes``); without, the bend is 0."""
    key, calendar = Window.partitionBy(*by), Window.partitionBy(*by, "moy")
    saturating = F.lit(False) if growth == "linear" else F.coalesce(
        F.col("logistic") & (F.col("cap") > 0), F.lit(False))
    inside = F.least(F.greatest(F.col("revenue"), F.col("cap") * 0.001), F.col("cap") * 0.999)
    line = _line(F.col("t"))
    trend = F.when(F.col("logistic"), F.col("cap") / (1 + F.exp(-line))).otherwise(line)
    # every calendar month weighs the same however many years it occurs in
    centre = F.sum(F.col("effect") * F.col("share")).over(key) / F.sum("share").over(key)
    seasonal = F.col("effect") - F.col("centre")
    points = (
        growth_columns(series, by)
        .withColumns({"logistic": saturating, "moy": F.month("month"),
                      "y": F.when(saturating, F.log(inside / (F.col("cap") - inside))).otherwise(F.col("revenue"))})
        .withColumns({"slope": F.coalesce(F.regr_slope("y", "t").over(key), F.lit(0.0)),
                      "intercept": F.coalesce(F.regr_intercept("y", "t").over(key), F.avg("y").over(key)),
                      "bend": F.lit(0.0), "kink": F.lit(0)}))
    if changes:
        points = settle(points)
        bent = slope_changes(points, by).withColumnsRenamed({c: f"_{c}" for c in ("kink", "bend", "slope", "intercept")})
        points = points.join(bent, list(by), "left").withColumns(
            {c: F.coalesce(f"_{c}", c) for c in ("bend", "slope", "intercept", "kink")}).drop("_kink", "_bend", "_slope", "_intercept")
    return (
        points.withColumn("residual", F.col("revenue") - trend)
        .withColumns({"effect": F.avg("residual").over(calendar), "share": 1 / F.count(F.lit(1)).over(calendar)})
        .withColumn("centre", centre)
        .groupBy(*by).agg(
            F.max("n").alias("n"), F.max("month").alias("last_month"), F.bool_or("logistic").alias("logistic"),
            F.max("cap").alias("cap"), F.max("slope").alias("slope"), F.max("intercept").alias("intercept"),
            F.max("kink").alias("kink"), F.max("bend").alias("bend"),
            F.coalesce(F.stddev_samp(F.col("residual") - seasonal), F.lit(0.0)).alias("sigma"),
            F.map_from_entries(F.collect_set(F.struct("moy", seasonal.alias("effect")))).alias("seasonal")))


def predict_seasonal_trend(model: DataFrame, by: Sequence[str] = SERIES, months: int = HORIZON) -> DataFrame:
    """Next ``months`` months of every model, before any clipping."""
    ahead = model.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(months))))
    line = _line(F.col("n") - 1 + F.col("h"))
    trend = F.when(F.col("logistic"), F.col("cap") / (1 + F.exp(-line))).otherwise(line)
    month = months_after(F.col("last_month"), F.col("h"))
    value = trend + F.coalesce(F.try_element_at("seasonal", F.month(month)), F.lit(0.0))
    return ahead.select(*by, month.alias("month"), "h", value.alias("forecast"),
                        (value - F.col("sigma") * Z_80).alias("lower"),
                        (value + F.col("sigma") * Z_80).alias("upper"))


def seasonal_forecast(series: DataFrame, growth: str | None = None, changes: bool = False) -> DataFrame:
    """Twelve clipped months per series."""
    raw = predict_seasonal_trend(fit_seasonal_trend(series, growth=growth, changes=changes))
    clipped = raw.withColumns({c: clip(F.col(c), low=0) for c in ("forecast", "lower", "upper")}).drop("h")
    return cap_outliers(clipped).withColumn("method", F.lit("seasonal"))


def rolling_origin(series: DataFrame, initial: int = 6, horizon: int = 3, changes: bool = False) -> DataFrame:
    """Forecast and actual for every cutoff month and step ahead.

    Each month is copied to the cutoffs it is history of (bounded by the calendar length, not
    by the data), and all (series, cutoff) models are fitted in one job."""
    key = Window.partitionBy("series_id")
    step = F.expr("interval 1 month")
    framed = (series.withColumn("_first", months_after(F.min("month").over(key), initial))
              .withColumn("_last", months_after(F.max("month").over(key), -horizon)))
    start = F.greatest("month", "_first")
    history = (framed.filter(F.col("_last") >= start)
               .withColumn("cutoff", F.explode(F.sequence(start, F.col("_last"), step)))
               .select("series_id", "cutoff", "month", "revenue"))
    by = ("series_id", "cutoff")
    ahead = predict_seasonal_trend(fit_seasonal_trend(history, by, changes=changes), by, horizon)
    return (ahead.join(series.select("series_id", "month", F.col("revenue").alias("actual")), ["series_id", "month"])
            .select(*by, "h", "month", clip(F.col("forecast"), low=0).alias("forecast"), "actual"))


def same_month_last_year(series: DataFrame, initial: int = 6, horizon: int = 3) -> DataFrame:
    """The naive yardstick on the same cutoffs, where last year's month exists."""
    scored = rolling_origin(series, initial, horizon).select("series_id", "cutoff", "h", "month", "actual")
    before = series.select("series_id", months_after(F.col("month"), 12).alias("month"),
                           F.col("revenue").alias("forecast"))
    return scored.join(before, ["series_id", "month"])


def backtest_by_horizon(scored: DataFrame) -> DataFrame:
    """Error figures per step ahead; MAPE is a fraction over months with revenue."""
    error = F.col("forecast") - F.col("actual")
    return scored.groupBy("series_id", "h").agg(
        F.count(F.lit(1)).alias("points"),
        F.avg(F.when(F.col("actual") > 0, F.abs(error) / F.col("actual"))).alias("mape"),
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error * error).alias("mse"))


def backtest_metrics(scored: DataFrame) -> DataFrame:
    """Mean of the per-step figures."""
    return backtest_by_horizon(scored).groupBy("series_id").agg(
        *[F.avg(m).alias(m) for m in ("mape", "mae", "rmse", "mse")])
