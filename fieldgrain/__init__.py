"""Distributed analytics over windowed-spectrum patch tables, built on PySpark DataFrames."""

__version__ = "0.1.0"
