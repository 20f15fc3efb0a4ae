"""Stage conversion rates and their lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from foresail.functions.expr import count_of, money, series_labels
from foresail.schema import ACTIVE_STAGES, ALL_STAGES, FALLBACK_RATES, FUNNEL_STAGES, MIN_SEGMENT_LEADS, STAGE_DATE

SEGMENT = ("lead_source", "is_repeat_customer")


def _counts(leads: DataFrame) -> DataFrame:
    """(stage, source, repeat, completed, total) in one combined aggregate over the leads.

    A lead counts for a stage if its current stage is that one or later (every lead counts for
    inquiry); it is completed for a stage if completed and, past inquiry, dated for the stage."""
    done = F.col("current_stage") == "completed"
    per_stage = []
    for i, stage in enumerate(ACTIVE_STAGES):
        reached = F.lit(True) if i == 0 else F.col("current_stage").isin(*FUNNEL_STAGES[i:])
        finished = done if i == 0 else done & F.col(STAGE_DATE[stage]).isNotNull()
        per_stage += [count_of(reached).alias(f"t{i}"), count_of(finished).alias(f"c{i}")]
    wide = leads.groupBy(*SEGMENT).agg(*per_stage)
    return wide.select(*SEGMENT, F.inline(F.array(*[
        F.struct(F.lit(s).alias("stage"), F.col(f"c{i}").alias("completed"), F.col(f"t{i}").alias("total"))
        for i, s in enumerate(ACTIVE_STAGES)])))


def rates_from_counts(counted: DataFrame, min_segment: int = MIN_SEGMENT_LEADS) -> DataFrame:
    """Flat and segment rates from (stage, source, repeat, completed, total) rows."""
    sums = (counted.groupingSets([["stage"], ["stage", *SEGMENT]], "stage", *SEGMENT)
            .agg(F.sum("completed").alias("completed"), F.sum("total").alias("total"),
                 (F.grouping_id() != 0).alias("is_flat")))
    rate = F.when(F.col("total") > 0, F.col("completed") / F.col("total")).otherwise(0.0)
    is_segment = (F.col("total") > 0) & F.col("lead_source").isNotNull() & F.col("is_repeat_customer").isin(0, 1)
    return (sums.filter(F.col("is_flat") | is_segment)
            .withColumn("rate", F.when(F.col("is_flat") | (F.col("total") >= min_segment), rate))
            .select("stage", *SEGMENT, "completed", "total", "rate", "is_flat"))


def conversion_rates(leads: DataFrame, min_segment: int = MIN_SEGMENT_LEADS) -> DataFrame:
    """Flat rates per stage and segment rates per (stage, source, repeat) as rows.

    Segments below ``min_segment`` keep their counts but have no rate."""
    return rates_from_counts(_counts(leads), min_segment)


def flat_conversion_rates(leads: DataFrame) -> DataFrame:
    return conversion_rates(leads).filter("is_flat").select("stage", "completed", "total", "rate")


def segment_conversion_rates(leads: DataFrame, min_segment: int = MIN_SEGMENT_LEADS) -> DataFrame:
    return (conversion_rates(leads, min_segment).filter(~F.col("is_flat"))
            .select("stage", *SEGMENT, "completed", "total", "rate"))


def conversion_summary(rates: DataFrame, min_segment: int = MIN_SEGMENT_LEADS) -> DataFrame:
    segment = ~F.col("is_flat")
    return rates.agg(count_of(segment & F.col("rate").isNotNull()).alias("kept_segments"),
                     count_of(segment).alias("total_segments"),
                     F.lit(min_segment).alias("min_segment_size"))


def fallback_rates(spark) -> DataFrame:
    """The fixed flat rates used where no history has been aggregated."""
    rows = [(s, None, None, 0, 0, r, True) for s, r in FALLBACK_RATES.items()]
    return spark.createDataFrame(
        rows, "stage string, lead_source string, is_repeat_customer int, completed long, total long, "
              "rate double, is_flat boolean")


def lookup_conversion_rate(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``conversion_rate`` and ``tier`` (segmented, flat, missing) to rows with a current_stage.

    Flat rates are at most one row per stage of the model and are broadcast. The segment table grows
    with the number of sources: for a lookup on single leads pass ``bounded(rates)``, which
    broadcasts it behind a check of its size."""
    segment = (rates.filter(~F.col("is_flat") & F.col("rate").isNotNull())
               .select(F.col("stage").alias("current_stage"), *SEGMENT, F.col("rate").alias("_seg")))
    flat = (rates.filter(F.col("is_flat") & F.col("stage").isin(*ALL_STAGES))
            .groupBy(F.col("stage").alias("current_stage")).agg(F.max("rate").alias("_flat")))
    return (rows.join(segment, ["current_stage", *SEGMENT], "left")
            .join(F.broadcast(flat), "current_stage", "left")
            .withColumn("conversion_rate", F.coalesce("_seg", "_flat", F.lit(0.0)))
            .withColumn("tier", F.when(F.col("_seg").isNotNull(), "segmented")
                        .when(F.col("_flat").isNotNull(), "flat").otherwise("missing"))
            .drop("_seg", "_flat"))


def open_value(open_leads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Open leads and their value by (keys, stage, source, repeat): the only pass over the leads."""
    dims = list(dict.fromkeys([*keys, "current_stage", *SEGMENT]))
    return open_leads.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("leads"), F.sum(money(F.col("trip_price"))).alias("value"))


def weighted_open_value(open_value_rows: DataFrame, rates: DataFrame) -> DataFrame:
    return lookup_conversion_rate(open_value_rows, rates).withColumn(
        "weighted", F.col("value").cast("double") * F.col("conversion_rate"))


def rule_totals(weighted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Expected revenue of the open leads per series: sum of price x conversion rate."""
    return (weighted.withColumn("series_id", F.explode(series_labels(keys)))
            .groupBy("series_id")
            .agg(F.sum("leads").alias("leads"), F.sum("value").cast("double").alias("open_value"),
                 F.sum("weighted").alias("total")))


def tier_usage(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("tier").agg(F.sum("leads").alias("leads"))


def open_value_details(weighted: DataFrame) -> DataFrame:
    """Open value overall, by stage and by full segment; ``level`` names the grouping."""
    dims = ["current_stage", *SEGMENT]
    gid = F.grouping_id()
    level = F.when(gid == 0, "segment").when(gid == 3, "stage").otherwise("total")
    known = (F.col("level") != "segment") | (F.col("lead_source").isNotNull()
                                             & F.col("is_repeat_customer").isNotNull())
    return (weighted.groupingSets([[], dims[:1], dims], *dims)
            .agg(F.sum("leads").alias("leads"), F.sum("value").cast("double").alias("value"),
                 F.sum("weighted").alias("weighted_revenue"), level.alias("level"))
            .filter(known))
