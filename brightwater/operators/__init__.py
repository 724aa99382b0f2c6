"""Operators that are more than one Spark call: as-of joins, pivots, JSON verbs, text search, graphs."""
