"""Operators on DataFrames: diff, apply, validation, and change processing."""
