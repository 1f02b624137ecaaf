"""Tidemark: find, track and measure events in gridded space-time data with PySpark."""
