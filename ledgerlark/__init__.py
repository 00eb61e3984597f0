"""Ledgerlark: filing analytics on Spark DataFrames."""
