"""Post-processing of keyed forecasts.

A forecast has one row per (series_id, month) with forecast, lower, upper - at most a few dozen
rows per series. Every operator partitions by ``series_id``, so chained operators share one
shuffle. History figures come from ``series_profile``; series without history pass unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foresail.functions.expr import clip, months_after, ratio
from foresail.schema import HORIZON, METHOD_WEIGHTS, SEED42_NORMALS

BANDS = ("forecast", "lower", "upper")


def _p():
    return Window.partitionBy("series_id")


def _w():
    return _p().orderBy("month")


def position() -> Column:
    return F.row_number().over(_w())


def with_history(forecast: DataFrame, profile: DataFrame) -> DataFrame:
    """Attach the profile's columns to every forecast row of the series."""
    return forecast.join(profile, "series_id", "left")


def known_columns(df: DataFrame) -> DataFrame:
    return df.select("series_id", "month", *BANDS)


def clip_non_negative(forecast: DataFrame) -> DataFrame:
    return forecast.withColumns({c: clip(F.col(c), low=0) for c in BANDS})


def cap_outliers(forecast: DataFrame) -> DataFrame:
    """Limit the forecast to three times its own median (when that is positive)."""
    capped = F.when((F.col("_n") > 1) & (F.col("_m") > 0), F.least("forecast", F.col("_m") * 3))
    return (forecast.withColumns({"_m": F.median("forecast").over(_p()), "_n": F.count(F.lit(1)).over(_p())})
            .select(*_replaced(forecast, forecast=F.coalesce(capped, F.col("forecast")))))


def _replaced(df: DataFrame, **new: Column) -> list[Column]:
    """All columns of ``df`` with some of them replaced: one projection, helpers left out."""
    return [new[c].alias(c) if c in new else F.col(c) for c in df.columns]


def cap_to_history(forecast: DataFrame, recent_mean: str = "recent_mean_6") -> DataFrame:
    """Clip to max(1.5 x history maximum, 2 x recent mean) and the upper bound to 1.5 x that,
    in series where any month exceeds it."""
    ceiling = F.greatest(F.col("hist_max") * 1.5, F.col(recent_mean) * 2)
    over = F.coalesce(F.col("_top") > ceiling, F.lit(False))
    return forecast.withColumn("_top", F.max("forecast").over(_p())).select(*_replaced(
        forecast,
        forecast=F.when(over, F.least("forecast", ceiling)).otherwise(F.col("forecast")),
        upper=F.when(over, F.least("upper", ceiling * 1.5)).otherwise(F.col("upper"))))


def _rebound(forecast: DataFrame, value: Column, when: Column, low: float, high: float) -> list[Column]:
    """The new forecast and, where ``when`` holds, bounds relative to it."""
    return _replaced(
        forecast, forecast=value,
        lower=F.when(when, clip(value * low, low=0)).otherwise(F.col("lower")),
        upper=F.when(when, clip(value * high, low=0)).otherwise(F.col("upper")))


def dampen_start(forecast: DataFrame, recent_mean: str = "plain_mean_6") -> DataFrame:
    """Pull a forecast that starts over 1.3 x the recent mean back towards it, less and less."""
    mean = F.col(recent_mean)
    high = F.coalesce(F.col("_first") > mean * 1.3, F.lit(False))
    share = 0.7 + 0.3 * (F.col("_i") - 1) / F.col("_n")
    value = F.when(high, F.col("forecast") * share + mean * (1 - share)).otherwise(F.col("forecast"))
    return (forecast.withColumns({"_i": position(), "_first": F.first("forecast").over(_w()),
                                  "_n": F.count(F.lit(1)).over(_p())})
            .select(*_rebound(forecast, value, high, 0.75, 1.25)))


def _draw(i: Column) -> Column:
    """Standard normal draw of a position: the fixed list, beyond it a Box-Muller draw from the position's hash."""
    z = F.array(*[F.lit(v) for v in SEED42_NORMALS])
    uniform = lambda seed: (F.pmod(F.xxhash64(F.lit(seed), i.cast("long")), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    later = F.sqrt(-2 * F.log(uniform(42))) * F.cos(2 * F.pi() * uniform(43))
    return F.coalesce(F.try_element_at(z, i), later)


def _numbered(forecast: DataFrame) -> DataFrame:
    return forecast.withColumns({"_i": position(), "_n": F.count(F.lit(1)).over(_p())})


def component_variation(forecast: DataFrame) -> DataFrame:
    """Scale each month by 1 + half the history's variation x its draw, within 0.7..1.3."""
    cv = F.coalesce(ratio(F.col("hist_std"), F.col("hist_mean"), 0.3), F.lit(0.3))
    factor = clip(1 + 0.5 * cv * _draw(F.col("_i")), 0.7, 1.3)
    on = (F.col("_n") > 1) & F.col("hist_mean").isNotNull()
    value = F.when(on, F.col("forecast") * factor).otherwise(F.col("forecast"))
    return _numbered(forecast).select(*_rebound(forecast, value, on, 0.75, 1.25))


def recent_variation() -> Column:
    """Coefficient of variation of recent history; 0.3 where it is undefined."""
    return F.coalesce(ratio(F.col("recent_std_12"), F.col("recent_mean_6"), 0.3), F.lit(0.3))


def ensemble_variation(forecast: DataFrame) -> DataFrame:
    """Scale each month by 1 + 0.4 x recent variation x its draw, within +-25 %."""
    swing = clip(0.4 * recent_variation() * _draw(F.col("_i")), -0.25, 0.25)
    on = (F.col("_n") > 1) & F.col("last_revenue").isNotNull()
    value = F.when(on, clip(F.col("forecast") * (1 + swing), low=0)).otherwise(F.col("forecast"))
    return _numbered(forecast).select(*_replaced(forecast, forecast=value))


def ewm_smooth(forecast: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Add ``smoothed``, the exponentially weighted mean: y0 = x0, yt = alpha xt + (1 - alpha) y(t-1).

    The fold runs over the window's own (short, ordered) history of the row."""
    upto = F.collect_list("forecast").over(_w().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fold = F.aggregate(F.slice("_x", 2, F.size("_x")), F.element_at("_x", 1),
                       lambda y, x: x * alpha + y * (1 - alpha))
    return forecast.withColumn("_x", upto).select(*forecast.columns, fold.alias("smoothed"))


def interval_rebuild(forecast: DataFrame) -> DataFrame:
    """Bounds at forecast x (1 +- recent variation), not below zero."""
    cv = recent_variation()
    on = F.col("last_revenue").isNotNull() & (F.col("_n") > 1)
    return forecast.withColumn("_n", F.count(F.lit(1)).over(_p())).select(*_replaced(
        forecast,
        lower=F.when(on, clip(F.col("forecast") * (1 - cv), low=0)).otherwise(F.col("lower")),
        upper=F.when(on, F.col("forecast") * (1 + cv)).otherwise(F.col("upper"))))


def transition_blend(forecast: DataFrame) -> DataFrame:
    """Lead in from the last month when the first forecast exceeds it by more than 30 %:
    months 0, 1, 2 carry 20, 40, 60 % of the forecast. Bounds of all months are rebuilt."""
    last = F.col("last_revenue")
    jump = F.coalesce(F.when(last > 0, F.col("_first") / last > 1.3).otherwise(last.isNotNull()), F.lit(False))
    share = 0.2 * F.col("_i")
    value = F.when(jump & (F.col("_i") <= 3), last * (1 - share) + F.col("forecast") * share).otherwise(
        F.col("forecast"))
    return (forecast.withColumns({"_i": position(), "_first": F.first("forecast").over(_w())})
            .select(*_rebound(forecast, value, jump, 0.7, 1.3)))


def spread_months(totals: DataFrame, start: Column, monthly: Column, low: float, high: float,
                  method: str) -> DataFrame:
    """Twelve equal months from ``start`` with fixed relative bounds."""
    return (totals.select("series_id", start.alias("_start"), monthly.alias("forecast"))
            .withColumn("month", F.explode(F.sequence(
                "_start", months_after(F.col("_start"), HORIZON - 1), F.expr("interval 1 month"))))
            .select("series_id", "month", "forecast", (F.col("forecast") * low).alias("lower"),
                    (F.col("forecast") * high).alias("upper"), F.lit(method).alias("method")))


def combine(components: DataFrame, weights: dict[str, float] = METHOD_WEIGHTS) -> DataFrame:
    """Weighted sum of the components per month; a month a component lacks counts as 0.

    Methods without a weight get 1/k of k components; the result is divided by the total
    weight of the series' components when that is not 1."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    methods = F.collect_set("method").over(_p())

    def weight(m):
        return F.coalesce(F.try_element_at(table, m), 1.0 / F.size("_methods"))

    total = F.aggregate("_methods", F.lit(0.0), lambda acc, m: acc + weight(m))
    scale = F.when(F.abs(F.col("_total") - 1) > 0.01, F.col("_total")).otherwise(1.0)
    return (components.withColumn("_methods", methods)
            .withColumns({"_w": weight(F.col("method")), "_total": total})
            .groupBy("series_id", "month")
            .agg(*[F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("_w")).alias(c) for c in BANDS],
                 F.max("_total").alias("_total"))
            .select("series_id", "month", *[(F.col(c) / scale).alias(c) for c in BANDS],
                    F.lit("ensemble").alias("method")))
