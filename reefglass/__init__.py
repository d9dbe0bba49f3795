"""Reefglass: search, facet and document-data analytics on PySpark DataFrames."""

__version__ = "0.1.0"
