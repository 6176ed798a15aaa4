"""Operators. Every function takes DataFrames and returns a lazily planned DataFrame."""
