"""Operators: DataFrames in, a DataFrame or named DataFrames out, all lazy but for the documented guards."""
