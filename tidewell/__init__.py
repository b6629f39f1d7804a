"""Streaming and analytical SQL over event data, on Spark DataFrames."""
