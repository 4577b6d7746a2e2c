"""Operators that run unchanged on streaming DataFrames."""
