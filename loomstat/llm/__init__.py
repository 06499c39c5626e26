"""Operators for training-data pipelines on text, vectors and web archives.

Nothing outside this package imports it.  Every operator takes and returns DataFrames.
"""
