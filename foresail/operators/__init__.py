"""DataFrame -> DataFrame operators on leads, monthly series and forecasts."""
