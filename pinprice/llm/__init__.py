"""Operators of a training-data pipeline on Spark DataFrames.

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface; ``queries`` binds them to the driver's
tables and derives the digest columns the contracts ask for.
"""
