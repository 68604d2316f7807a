"""Ordered market data on Spark: bars, indicators, labels, samples, metrics and trade analytics as DataFrame functions."""
