"""Retail order-event analytics on Spark DataFrames."""
