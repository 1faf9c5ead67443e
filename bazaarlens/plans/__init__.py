"""Compositions of operators: the batch load and the registered reports."""
