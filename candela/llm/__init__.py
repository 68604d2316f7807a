"""Operators of a large-scale training-data pipeline, each a function from DataFrames to a DataFrame."""
