"""Operators: each takes DataFrames and returns a DataFrame, and runs no job of its own."""
