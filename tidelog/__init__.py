"""Tidelog: log analytics expressed as Spark DataFrames."""
