"""Data profiling and ML-readiness diagnostics on Spark DataFrames.

DataFrame in, DataFrames out.  See README.md for the map of operators.
"""
