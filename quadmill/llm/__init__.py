"""Operators for preparing language-model training data, built on DataFrames.

Nothing outside this package imports it; ``queries`` lists the ten registered queries.
"""
