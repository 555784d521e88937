"""Spark-native operators for studying how markets react to company filings."""

__version__ = "0.1.0"
