"""Catalogue operators over DataFrames."""
