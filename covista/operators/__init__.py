"""Relational operators of the job: filters, joins, aggregates, windows, and graph methods."""
