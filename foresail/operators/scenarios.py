"""Scenario levers and their application to a forecast."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from foresail.schema import SCENARIO_LEVERS


def scenario_parameters(spark: SparkSession) -> DataFrame:
    """The published levers: name, key, min, max, default, description."""
    rows = [(name, name, low, high, default, text) for name, low, high, default, text in SCENARIO_LEVERS]
    return spark.createDataFrame(rows, "name string, key string, min int, max int, default int, description string")


def _factor(settings: Mapping[str, float]) -> float:
    out = 1.0
    for name, low, high, default, _ in SCENARIO_LEVERS:
        out *= 1 + min(max(settings.get(name, default), low), high) / 100
    return out


def apply_scenarios(forecast: DataFrame, scenarios: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Every forecast month under every named scenario; settings are clamped to their lever's range."""
    table = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(_factor(s)).alias("factor"))
                      for n, s in scenarios.items()])
    rows = forecast.select("*", F.inline(table))
    return rows.withColumns({c: F.col(c) * F.col("factor") for c in ("forecast", "lower", "upper")})


def lever_range_scenarios() -> dict[str, dict[str, float]]:
    """For each lever its minimum, default and maximum with all others at their default."""
    return {f"{name}:{what}": {name: value}
            for name, low, high, default, _ in SCENARIO_LEVERS
            for what, value in (("min", low), ("default", default), ("max", high))}
