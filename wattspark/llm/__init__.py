"""Operators of a training-data pipeline over ``documents``.

One module per operator, each a set of plain functions on DataFrames; ``queries.py`` holds the
thin registered queries and their SQL. Nothing outside this package imports it.
"""
