"""Span-based text analytics on Spark: segmentations and contingency tables as DataFrames."""

__version__ = "0.1.0"
