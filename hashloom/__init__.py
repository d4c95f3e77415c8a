"""Strings to sparse hashed vectors, as DataFrame transforms."""

__version__ = "1.0.0"
