"""Telemetry and document analytics on Spark DataFrames."""
