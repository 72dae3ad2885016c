"""Shelfmark: catalogue analytics and data quality on Spark DataFrames."""

__version__ = "0.1.0"
