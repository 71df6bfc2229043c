"""Operators over columns and DataFrames."""
