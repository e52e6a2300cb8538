"""Retail operations analytics on Spark: DataFrames in, DataFrames out."""
