"""Density-based outlier analytics on Spark DataFrames."""
