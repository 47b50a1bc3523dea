"""Queries over the sample tables, grouped by topic."""
