"""Analytics of crawled web pages on PySpark."""

__version__ = "0.1.0"
