"""Relational operators: projections, joins, aggregates, windows and set operations."""
