"""Volumetric analytics on Spark: dense image volumes as DataFrames."""

__version__ = "0.1.0"
