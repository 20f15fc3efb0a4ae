"""Lead view over the order tables: one lead per order, segments from the customer's region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FIXTURE_AS_OF = "2001-08-01"
_OPEN_SINCE = "2001-02-02"


# Declared so that opening a table reads no footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (read_table(spark, sf_dir, t) for t in ("nation", "region"))
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("r_name").alias("destination"))


def leads_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derive the lead table from orders, customer, nation and region.

    The returning-customer flag needs each customer's first order. A window per customer
    would put a dominant customer into one task, so the first order is found by a combined
    aggregate and matched back on the (unique) order key instead. The customer join is a
    plain equi-join: small customer tables broadcast by measured size, large ones
    sort-merge, where adaptive execution splits a dominant customer."""
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_orderstatus").alias("st"),
        F.col("o_orderdate").cast("date").alias("inquiry_date"), "o_totalprice")
    first = (orders.groupBy("o_custkey")
             .agg(F.min(F.struct("inquiry_date", "k")).alias("first"))
             .select(F.col("first.k").alias("first_k")))
    customer = (read_table(spark, sf_dir, "customer")
                .join(_places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
                .select("c_custkey", F.col("c_mktsegment").alias("lead_source"), "destination"))
    k, inquiry = F.col("k"), F.col("inquiry_date")
    rep = F.when(F.col("first_k").isNull(), 1).otherwise(0)
    h = (k * 7919 + 13) % 100
    lift = 15 * rep
    still_open = (inquiry >= F.lit(_OPEN_SINCE).cast("date")) & (F.col("st") != "F")
    stage = (F.when(still_open & (h < 50), "inquiry").when(still_open & (h < 80), "quote_sent")
             .when(still_open & (h < 95), "booked").when(still_open, "final_payment")
             .when(h < 35 + lift, "completed").when(h < 38 + lift, "cancelled").otherwise("lost"))
    staged = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
              .join(first, k == F.col("first_k"), "left")
              .select("k", "inquiry_date", "destination", "lead_source", "o_totalprice",
                      stage.alias("current_stage"), rep.cast("int").alias("is_repeat_customer")))

    # days from the inquiry to each later date
    quote = 1 + k % 7
    booking = quote + 5 + k % 26
    trip = booking + 30 + k % 151
    payment = trip - (7 + k % 24)

    def dated(stages, days, also=F.lit(False)):
        return F.when(F.col("current_stage").isin(*stages) | also, F.date_add(inquiry, days.cast("int")))

    paid = ("final_payment", "completed", "cancelled")
    booked = ("booked", *paid)
    return staged.select(
        F.concat(F.lit("LEAD_"), k.cast("string")).alias("lead_id"), "inquiry_date", "destination",
        F.when(F.col("current_stage").isin("lost", "cancelled"), 0.0).otherwise(F.col("o_totalprice"))
        .alias("trip_price"),
        "lead_source", "current_stage", "is_repeat_customer",
        dated(("quote_sent", *booked), quote, (F.col("current_stage") == "lost") & (h % 2 == 0)).alias("quote_date"),
        dated(booked, booking).alias("booking_date"), dated(booked, trip).alias("trip_date"),
        dated(paid, payment).alias("final_payment_date"),
        F.element_at(F.array(*[F.lit(d) for d in (7, 10, 14, 21)]), (k % 4).cast("int") + 1).alias("duration_days"))


def supplier_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items shaped as completed leads keyed by supplier: many short series."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("lead_id"),
        F.col("l_suppkey").cast("string").alias("supplier"),
        F.col("l_extendedprice").alias("trip_price"),
        F.lit("completed").alias("current_stage"),
        F.col("l_shipdate").cast("date").alias("trip_date"))
