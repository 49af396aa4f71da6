"""Spark-native portfolio analytics: returns, bars, orders, NAV and events as DataFrames."""

__version__ = "0.1.0"
