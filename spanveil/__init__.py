"""Sensitive-text engine on Spark DataFrames."""
