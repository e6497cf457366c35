"""notewarp: a Spark-native engine for evidence-backed knowledge graphs over notes and text."""

__version__ = "0.1.0"
