"""The same embedding over unbounded input."""

from .embed_stream import embed_stream, line_stream

__all__ = ["embed_stream", "line_stream"]
