"""Operators over DataFrames; column names are parameters."""
