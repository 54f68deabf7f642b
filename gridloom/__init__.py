"""Learned spatial indexing and large-scale point analytics on Spark DataFrames."""
