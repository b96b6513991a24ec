"""Operators for preparing training text, and their registered queries.

Nothing outside this package imports it. Every operator takes DataFrames and returns DataFrames;
work on whole texts runs inside tasks over Arrow batches, and Spark does all partitioning.
"""
