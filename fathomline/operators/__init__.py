"""Operators over weekly panels: DataFrames in, DataFrames out."""
