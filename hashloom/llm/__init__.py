"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, reads whole tables and whole texts, and is deterministic, so a task
that is run again after an executor is lost gives the same rows.
"""
