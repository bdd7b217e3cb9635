"""Operators of the catalogue, each from DataFrames to a DataFrame."""
