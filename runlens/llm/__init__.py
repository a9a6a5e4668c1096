"""Operators for large training-data corpora.

Every operator takes and returns DataFrames.  Nothing outside this subpackage
imports it.
"""
