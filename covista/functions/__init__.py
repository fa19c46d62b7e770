"""Column expressions (PMI weights) and distributed exact percentiles."""
