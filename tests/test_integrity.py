"""Labels, cells and draws that must not collide, fail or run out."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from foresail.functions.expr import series_labels
from foresail.functions.ranks import global_rank
from foresail.operators.forecasts import _draw
from foresail.schema import LEAD_COLUMNS
from foresail.sources.csv_leads import coerce_dates, typed_leads
from foresail.streaming.uploads import current_leads


def test_labels_are_distinct(spark):
    rows = spark.createDataFrame([("a|y=b", "c"), ("a", "b|y=c"), ("ALL", "z"), ("x=ALL", "z\\")], "x string, y string")
    for keys in (["x"], ["x", "y"]):
        own = [r[0][1] for r in rows.select(series_labels(keys)).collect()]
        assert len(set(own)) == 4 and "ALL" not in own


@pytest.mark.parametrize("text, day", [("01/05/2024", date(2024, 1, 5)), ("2024-02-01 00:00:00", date(2024, 2, 1)), ("2024-02-01", date(2024, 2, 1)), ("2023-13-40", None), ("", None)])
def test_date_spellings(spark, text, day):
    assert coerce_dates(spark.createDataFrame([(text,)], "trip_date string"), ["trip_date"]).first()[0] == day


def test_odd_numbers_are_null(spark):
    rows = spark.createDataFrame([("A", "9999999999"), ("B", "7.5"), ("C", "14")], "lead_id string, duration_days string")
    assert [r.duration_days for r in typed_leads(rows).orderBy("lead_id").collect()] == [None, None, 14]


def test_draws_do_not_run_out(spark):
    draws = [r[0] for r in spark.range(1, 41).select(_draw(F.col("id").cast("int"))).collect()]
    assert len(set(draws)) == 40 and max(map(abs, draws)) < 6


def test_global_rank(spark):
    ranked = global_rank(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(7), [F.col("v")], "place")
    assert all(r.v == r.place for r in ranked.collect())


def test_rows_without_id_stay_apart(spark, tmp_path):
    fields = ", ".join(f"{c} string" for c in LEAD_COLUMNS)
    row = lambda ident, stage: tuple(ident if c == "lead_id" else stage if c == "current_stage" else None for c in LEAD_COLUMNS)
    from foresail.streaming.uploads import lead_state
    rows = spark.createDataFrame([row(None, "lost"), row(None, "lost"), row("A", "inquiry"), row("A", "lost")], fields)
    typed = typed_leads(rows).withColumn("uploaded", F.when(F.col("current_stage") == "lost", "2").otherwise("1"))
    lead_state(spark, str(tmp_path / "state")).merge(typed, 0)
    assert sorted((r.lead_id or "", r.current_stage) for r in current_leads(spark, str(tmp_path / "state")).collect()) == [("", "lost"), ("", "lost"), ("A", "lost")]
