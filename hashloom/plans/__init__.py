"""From a configuration to a plan."""

from .embedder import Embedder

__all__ = ["Embedder"]
