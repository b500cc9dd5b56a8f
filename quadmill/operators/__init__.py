"""Operators over tables of facts."""
