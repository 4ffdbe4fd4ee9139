"""Operators on DataFrames of chunks, results, graphs and versions."""
