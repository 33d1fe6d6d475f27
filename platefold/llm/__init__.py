"""Operators of a training-data pipeline, each a Spark job over a documents table.

Every operator takes DataFrames and column names and returns a DataFrame.  The
thin queries that the driver runs are in :mod:`platefold.llm.queries`.
"""
