"""Commerce analytics as Spark DataFrame operators.

Every operator takes DataFrames with the logical columns of
:mod:`bazaarlens.schemas` plus plain parameters and returns a DataFrame; the
caller picks the action.
"""
