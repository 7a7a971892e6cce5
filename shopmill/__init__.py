"""Stored product pages to shop catalog, as Spark DataFrame jobs."""

__version__ = "0.1.0"
