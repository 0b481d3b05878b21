"""Batch operators: each takes and returns DataFrames or builds columns."""
