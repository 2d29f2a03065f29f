"""Operators of a training-data pipeline, each on plain Spark DataFrames.

Nothing outside this subpackage imports it; ``queries`` lists what it registers.
"""
