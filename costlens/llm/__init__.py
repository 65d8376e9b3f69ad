"""Operators for large text and vector collections, and the queries that apply them.

Nothing else in the library imports this package.  Columns are picked by name on
entry, so extra columns of the input never clash with those an operator adds.
"""
