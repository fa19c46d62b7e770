"""Composite pipelines, the registered queries and their DuckDB oracle SQL."""
