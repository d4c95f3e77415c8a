"""Readers that give (row_id, src, label, data)."""

from .readers import SOURCES, read_source

__all__ = ["SOURCES", "read_source"]
