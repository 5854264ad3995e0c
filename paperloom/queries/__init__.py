"""Queries that show each operator on the given tables, with their SQL."""
