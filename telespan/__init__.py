"""Telemetry analytics and forecast evaluation on Spark DataFrames."""
