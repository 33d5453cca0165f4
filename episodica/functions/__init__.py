"""Column functions: array transforms and text functions."""
