"""Spark-native engine for price-bar series, account risk and training data."""
