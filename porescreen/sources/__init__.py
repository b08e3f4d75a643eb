"""Scans: structure text, dimension tables, path and barrier text, model and trajectory tables."""
