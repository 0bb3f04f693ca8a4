"""Versioned-object analytics on Spark DataFrames."""
