"""Similarity-graph analytics on Spark DataFrames."""
