"""Operators for preparing text corpora, each a function from DataFrames to a DataFrame."""
