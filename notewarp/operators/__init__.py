"""Relational, graph and incremental operators over DataFrames."""
