"""Structured-grid analytics on Spark DataFrames."""
