"""Operators: DataFrames of segments, findings, groups and masks in, DataFrames out."""
