"""Spark analytics: market-anomaly detection over irregular series."""
