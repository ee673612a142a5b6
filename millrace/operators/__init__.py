"""Operators over flows and tables."""
