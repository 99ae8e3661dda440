"""Gridded land-surface analytics on Spark DataFrames."""
