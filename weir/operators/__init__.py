"""Operators over DataFrames: aggregates, windows, per-row state, event time, shaping."""
