"""Analytics for threaded, multi-user conversation data on Spark DataFrames."""

__version__ = "0.1.0"
