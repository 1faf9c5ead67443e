"""Operators for preparing training data, their queries and their SQL statements.

Nothing else in the library imports this subpackage.
"""
