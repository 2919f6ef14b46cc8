"""Operators over DataFrames; each module's docstrings state the result for nulls, ties and empty input."""
