"""Operators: each takes a table and returns a lazy table or DataFrame."""
