"""Quadmill: graph-shaped data on Spark."""
