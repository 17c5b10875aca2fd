"""Queries: notation, analysis and translation to DataFrames."""
