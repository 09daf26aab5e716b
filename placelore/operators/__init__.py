"""Operators: DataFrames and parameters in, DataFrame out, no actions inside unless stated."""
