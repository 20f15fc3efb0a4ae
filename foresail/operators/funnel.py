"""Sales funnel: stage counts, step rates, visibility and summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from foresail.functions.expr import count_of, label_of, money
from foresail.operators.leads import active_leads, inquiry_cohort
from foresail.schema import ACTIVE_STAGES, ALL_STAGES, DEFAULT_COLOR, FUNNEL_STAGES, STAGE_COLOR, STAGE_DATE


def _one_pass(leads: DataFrame, by: Sequence[str], members: dict[str, Column]) -> DataFrame:
    """Count and revenue of every stage's members in one aggregate, then one row per stage."""
    aggs = [F.count(F.lit(1)).alias("_all")]
    for i, cond in enumerate(members.values()):
        aggs += [count_of(cond).alias(f"_n{i}"),
                 F.coalesce(F.sum(F.when(cond, money(F.col("trip_price")))), F.lit(0))
                 .cast("double").alias(f"_v{i}")]
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("stage_no"), F.lit(s).alias("stage"), F.col(f"_n{i}").alias("count"),
                 F.col(f"_v{i}").alias("revenue_potential")) for i, s in enumerate(members)])
    return leads.groupBy(*by).agg(*aggs).filter("_all > 0").select(*by, F.inline(rows))


def funnel_cohort(leads: DataFrame, start, end, by: Sequence[str] = ()) -> DataFrame:
    """Leads inquired in [start, end] and how many of them carry each stage's date."""
    return _one_pass(inquiry_cohort(leads, start, end), by,
                     {s: F.col(STAGE_DATE[s]).isNotNull() for s in FUNNEL_STAGES})


def funnel_current(leads: DataFrame, as_of, by: Sequence[str] = ()) -> DataFrame:
    """Active leads by the stage they are in now; stages without leads count 0."""
    return _one_pass(active_leads(leads, as_of), by,
                     {s: F.col("current_stage") == s for s in ACTIVE_STAGES})


def _pick(values: dict[str, str], c: Column, default: str) -> Column:
    return reduce(lambda acc, kv: F.when(c == kv[0], kv[1]).otherwise(acc), values.items(), F.lit(default))


def funnel_rates(funnel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step conversion and drop-off in percent; rows are stages, so the window is tiny."""
    prev = F.lag("count").over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("stage_no"))
    conv = F.when(F.col("_prev") > 0, F.col("count") / F.col("_prev") * 100).otherwise(0.0)
    first = F.col("_prev").isNull()
    return (funnel.withColumn("_prev", prev)
            .withColumn("conversion_rate", F.when(~first, F.bround(conv, 1)))
            .withColumn("drop_off_rate", F.when(~first, F.bround(100 - conv, 1)))
            .withColumn("avg_days_in_stage", F.lit(None).cast("double"))
            .withColumn("color", _pick(STAGE_COLOR, F.col("stage"), DEFAULT_COLOR))
            .drop("_prev"))


def stage_counts(leads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return leads.filter(F.col("current_stage").isNotNull()).groupBy(*by, F.col("current_stage").alias("stage")).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(money(F.col("trip_price"))).cast("double").alias("revenue_potential"))


def funnel_visibility(rows: DataFrame, show_lost: bool = False, show_cancelled: bool = False) -> DataFrame:
    """Hide lost/cancelled unless wanted and number the stages in funnel order (unknown: 999)."""
    hidden = [s for s, show in (("lost", show_lost), ("cancelled", show_cancelled)) if not show]
    place = reduce(lambda acc, iv: F.when(F.lower("stage") == iv[1], iv[0]).otherwise(acc),
                   enumerate(ALL_STAGES, start=1), F.lit(999))
    shown = rows.filter(~F.col("stage").isin(*hidden)) if hidden else rows
    return (shown.withColumn("stage_no", place).withColumn("stage_label", label_of(F.col("stage")))
            .orderBy("stage_no"))


def funnel_steps(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bar width against the first stage and conversion against the previous one, in percent."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("stage_no")
    return (rows.withColumn("width_pct", F.col("count") / F.nullif(F.first("count").over(w), F.lit(0)) * 100)
            .withColumn("step_pct", F.col("count") / F.nullif(F.lag("count").over(w), F.lit(0)) * 100))


def funnel_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total leads and value, last stage against first, mean step conversion."""
    n, first, last = F.count(F.lit(1)), F.min_by("count", "stage_no"), F.max_by("count", "stage_no")
    return (funnel_steps(rows, by).groupBy(*by).agg(
        F.sum("count").alias("total_count"),
        F.when(n > 1, last / F.nullif(first, F.lit(0)) * 100).otherwise(0.0).alias("overall_pct"),
        F.sum("revenue_potential").alias("total_potential"),
        F.when(n > 1, F.sum("step_pct") / (n - 1)).otherwise(0.0).alias("mean_step_pct")))
