"""Spark-native daily market-data analytics: contracts, as-of models, indicators, screening, ledgers."""

__version__ = "0.1.0"
