"""Composed queries: what a caller runs, one function each."""
