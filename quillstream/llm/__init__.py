"""Operators for preparing training data, each a function from DataFrames to a DataFrame.

Nothing outside this subpackage imports it. ``registry`` lists the queries that apply the operators to the tables.
"""
