"""Scalar functions and text functions."""
