"""Similarity search over data series, as DataFrames."""
