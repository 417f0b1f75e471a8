"""User-level operators: DataFrames in, DataFrames out."""
