"""Relational operators: dedup, splits, metrics, selection, geometry, temporal logic and tracking."""
