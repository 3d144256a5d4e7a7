"""Whole runs: domains, detector registry, stored and resumed work."""
