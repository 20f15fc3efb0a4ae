"""foresail: revenue forecasting and sales-funnel analytics as Spark DataFrame functions."""
