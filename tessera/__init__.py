"""Inspection, profiling, comparison, merging, splitting and conversion of tabular data on Apache Spark."""

__version__ = "0.1.0"
