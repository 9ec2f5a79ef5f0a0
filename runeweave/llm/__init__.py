"""Operators of a training-data pipeline, on Spark DataFrames.

Nothing outside this folder imports it.  Operators take and return DataFrames; `queries.py`
holds the thin queries over the tables of a data folder and their SQL.
"""
