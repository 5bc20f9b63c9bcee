"""Operators for large training-data pipelines, written on Spark DataFrames.

Nothing outside this subpackage imports it; it imports nothing from the rest of the library.
"""
