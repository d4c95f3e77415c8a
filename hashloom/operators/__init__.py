"""Operators on whole DataFrames: embedding, IDF, dictionary, vector joins."""
