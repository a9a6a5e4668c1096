"""Operators over the three history tables."""
