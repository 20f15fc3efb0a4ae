"""What must hold on large data: plans, skew and independence from broadcasts."""

import re

import pytest
from pyspark.sql import functions as F

from foresail.operators import leads as B, rates as R, series as S, stats as ST
from foresail.plans import catalog
from foresail.plans.forecast import lead_cube
from foresail.sources.tables import leads_from_orders, supplier_sales
from places import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


CHECKED = [n for n in catalog.QUERIES if not n.startswith(("f3_", "a7_", "k1_")) and "model" not in n and "scored" not in n
           and (n[0] in "abcd" or n in ("e4_drop_collapsed_last_month", "f2_stratified_split", "f10_forecast_12_months", "g3_report_completeness"))
           and not n.startswith(("d22", "d25", "d26", "d27", "d28", "d29", "d30", "b7", "a4", "a5"))]


@pytest.mark.parametrize("name", CHECKED)
def test_no_nested_loops_and_no_python(spark, no_broadcast, name):
    text = plan(catalog.QUERIES[name](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in text


def test_monthly_revenue_combines_before_one_shuffle_of_the_leads(spark):
    text = plan(S.trimmed_series(S.monthly_revenue(supplier_sales(spark, SMALL), ["supplier"], "2001-08-01")))
    # segment totals, series totals, series order: the raw rows are only behind the first
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 3
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in scan
    below = text[text.rindex("Exchange hashpartitioning"):]
    assert "partial_sum" in below and "Window" not in below


def test_windows_share_one_partitioning(spark):
    history = S.trimmed_series(S.monthly_revenue(supplier_sales(spark, SMALL), ["supplier"]))
    from foresail.plans.trend import fit_seasonal_trend
    assert plan(fit_seasonal_trend(history)).count("Exchange hashpartitioning") == 3


def test_cube_scans_leads_once_and_reads_few_columns(spark):
    text = plan(lead_cube(leads_from_orders(spark, SMALL), ["destination"], "2001-08-01"))
    assert text.count("orders.parquet") == 2     # the leads and their first orders
    assert "o_orderpriority" not in text and "c_acctbal" not in text


def test_history_filters_reach_the_scan(spark):
    leads = spark.read.parquet(f"{SMALL}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("lead_id"), F.col("o_orderstatus").alias("current_stage"),
        F.col("o_orderdate").alias("trip_date"), F.col("o_totalprice").alias("trip_price"))
    text = plan(S.monthly_revenue(leads))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,completed\)", text)


@pytest.fixture(scope="module")
def skewed_tables(spark, tmp_path_factory):
    """A third of all orders belong to one customer, so to one destination and source."""
    folder = tmp_path_factory.mktemp("skew")
    for t in ("customer", "nation", "region"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(F.col("o_custkey")).cast("long")) \
        .write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_first_order_flag_under_skew(spark, skewed_tables, no_broadcast):
    got = {r.lead_id: r.is_repeat_customer for r in leads_from_orders(spark, skewed_tables).collect()}
    seen, want = set(), {}
    for r in spark.read.parquet(f"{skewed_tables}/orders.parquet").orderBy("o_orderdate", "o_orderkey").collect():
        want[f"LEAD_{r.o_orderkey}"] = int(r.o_custkey in seen)
        seen.add(r.o_custkey)
    assert got == want


@pytest.mark.parametrize("name", ["c3_lookup_conversion_rate", "d5_revenue_stats_by_destination", "d32_classification_metrics",
                                  "f10_forecast_12_months"])
def test_same_result_without_broadcasts_and_with_other_partitions(spark, skewed_tables, name):
    def rows():
        df = catalog.QUERIES[name](spark, skewed_tables)
        return sorted(map(str, df.select(*sorted(df.columns)).collect()))

    want = rows()
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions",
                                          "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                          "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for k, v in zip(old, ("-1", "13", "4k", "2k")):
            spark.conf.set(k, v)
        assert rows() == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_copies_of_one_row_are_combined_before_the_shuffle(spark):
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"))
    assert "partial_count" in plan(ST.duplicate_records(rows))
    assert ST.duplicate_records(rows).first()[0] == 9999


def test_open_value_shrinks_before_rates_are_joined(spark):
    leads = leads_from_orders(spark, SMALL)
    weighted = R.weighted_open_value(R.open_value(B.open_leads(leads, "2001-08-01")), R.fallback_rates(spark))
    assert weighted.count() <= 4 * 5 * 2


def test_shared_folder_comes_from_the_session(spark):
    from foresail.session import scratch_path, shared_dir
    first = shared_dir(spark)
    assert shared_dir(spark) == first and scratch_path(spark, "x").startswith(first)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
