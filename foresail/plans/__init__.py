"""Composed forecasts, models and the query catalogue."""
