"""Lodemill: SQL dialect, document API and data operators on Spark DataFrames."""

__version__ = "0.1.0"
