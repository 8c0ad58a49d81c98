"""Weftmark: documentation/code traceability and corpus operators as Spark DataFrames."""

__version__ = "0.1.0"
