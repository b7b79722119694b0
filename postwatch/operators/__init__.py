"""Operators: DataFrames in, DataFrame out, no action and no I/O."""
