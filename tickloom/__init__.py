"""Tick, bar and message analytics on Spark DataFrames."""
