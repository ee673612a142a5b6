"""Ordered-flow analytics on Spark."""
