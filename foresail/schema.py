"""Lead schema, stage model and the fixed values the engine works with."""

from __future__ import annotations

from pyspark.sql import types as T

LEAD = T.StructType([
    T.StructField("lead_id", T.StringType()),
    T.StructField("inquiry_date", T.DateType()),
    T.StructField("destination", T.StringType()),
    T.StructField("trip_price", T.DoubleType()),
    T.StructField("lead_source", T.StringType()),
    T.StructField("current_stage", T.StringType()),
    T.StructField("is_repeat_customer", T.IntegerType()),
    T.StructField("quote_date", T.DateType()),
    T.StructField("booking_date", T.DateType()),
    T.StructField("trip_date", T.DateType()),
    T.StructField("final_payment_date", T.DateType()),
    T.StructField("duration_days", T.IntegerType()),
])
LEAD_COLUMNS = LEAD.fieldNames()

# --- fixed values: names and thresholds every result depends on ---------------
REQUIRED_COLUMNS = ("lead_id", "inquiry_date", "trip_price", "current_stage", "trip_date", "booking_date")
DATE_COLUMNS = ("inquiry_date", "trip_date", "booking_date", "quote_date", "final_payment_date")

ACTIVE_STAGES = ("inquiry", "quote_sent", "booked", "final_payment")
FUNNEL_STAGES = ("inquiry", "quote_sent", "booked", "final_payment", "completed")
RESOLVED_STAGES = ("completed", "lost", "cancelled")
ALL_STAGES = FUNNEL_STAGES + ("lost", "cancelled")
STAGE_DATE = {
    "inquiry": "inquiry_date",
    "quote_sent": "quote_date",
    "booked": "booking_date",
    "final_payment": "final_payment_date",
    "completed": "trip_date",
}
STAGE_COLOR = {
    "inquiry": "#0ea5e9",
    "quote_sent": "#3b82f6",
    "booked": "#8b5cf6",
    "final_payment": "#10b981",
    "completed": "#059669",
}
DEFAULT_COLOR = "#6b7280"

DAYS_PER_YEAR = 365.25
MIN_HISTORY_YEARS = 1.0
MIN_SEGMENT_LEADS = 20
MIN_TRAINING_ROWS = 50
FALLBACK_RATES = {"inquiry": 0.15, "quote_sent": 0.35, "booked": 0.90, "final_payment": 0.98}
PEAK_MONTHS = (1, 2, 3, 9, 10)

HORIZON = 12
Z_80 = 1.2816
METHOD_WEIGHTS = {"seasonal": 0.4, "scored": 0.3, "rules": 0.3}
SCENARIO_LEVERS = (
    # name, min %, max %, default %, description
    ("Growth Rate", -20, 50, 0, "Expected annual growth rate (%)"),
    ("Market Growth", -10, 30, 0, "Overall market growth impact (%)"),
    ("Marketing Spend", -5, 25, 0, "Impact of marketing investment (%)"),
    ("Seasonality", -15, 15, 0, "Seasonal variation adjustment (%)"),
    ("Customer Retention", -10, 20, 0, "Impact of customer retention improvements (%)"),
)
# Standard normal draws of numpy's legacy generator for seed 42, positions 0-11.
SEED42_NORMALS = (
    0.4967141530112327, -0.13826430117118466, 0.6476885381006925, 1.5230298564080254,
    -0.23415337472333597, -0.23413695694918055, 1.5792128155073915, 0.7674347291529088,
    -0.4694743859349521, 0.5425600435859647, -0.46341769281246226, -0.46572975357025687,
)
# ------------------------------------------------------------------------------

ALL = "ALL"
