"""Writers for vectors."""

from .writers import SINKS, write_vectors

__all__ = ["SINKS", "write_vectors"]
