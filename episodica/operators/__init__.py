"""Operators on frame, metric and record tables. Each takes and returns DataFrames and stays inside Catalyst."""
