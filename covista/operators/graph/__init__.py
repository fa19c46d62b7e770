"""Graph methods as iterative DataFrame jobs keyed by ``(graph key, vertex)``."""
