"""Tabular profiling, feature preparation and model comparison on Spark DataFrames."""
