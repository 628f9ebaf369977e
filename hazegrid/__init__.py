"""Hourly air-quality panel analytics on Spark DataFrames."""
