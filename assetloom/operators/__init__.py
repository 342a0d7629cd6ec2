"""Operators on the catalog's tables."""
