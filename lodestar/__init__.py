"""Spark-native analytics for price bars, events, odds and pages."""
