"""Queries against their SQL at the smallest scale. FORESAIL_ALL=1 runs every one of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from places import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SOME = """a1_read_leads_csv a7_saved_forecasts b4_reclassify_future_trips b8_mask_for_role c3_lookup_conversion_rate
c4_monthly_bookings d1_supplier_series d5_revenue_stats_by_destination d9_open_lead_stats d11_duplicate_records
d15_segment_conversion_rates d17_funnel_cohort d19_funnel_rates d21_open_value_details d23_horizon_kpis
d32_classification_metrics e2_flag_incomplete_months e4_supplier_series e6_recent_stats e10_ewm_smooth e14_cap_forecast
f1_category_codes f2_stratified_split f7_supplier_trend f8_rolling_origin_backtest f9_combine_ensemble
f10_forecast_with_scores g1_insights g2_key_drivers g3_report_completeness k1_stream_monthly_revenue""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("FORESAIL_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    got = normal(df.columns, df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    assert got == normal([d[0] for d in cursor.description], cursor.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["series_id", "month", "forecast", "lower", "upper", "method"] and df.count() == 72
