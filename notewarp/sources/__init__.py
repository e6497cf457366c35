"""Readers: Parquet tables, landed JSON and the paged note feed."""
