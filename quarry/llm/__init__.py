"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames, finds rows by their ``doc_id`` and documents its results for nulls,
empty texts, ties, repeated rows, empty tables and clashing column names.
"""
