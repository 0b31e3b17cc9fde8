"""Traffic analytics on Spark: from zone events to forecasting tables."""
