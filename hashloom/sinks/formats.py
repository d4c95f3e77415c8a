"""How one vector is written as text."""

from __future__ import annotations

import numpy as np


def g6(x: float) -> str:
    """C's %g: six significant digits."""
    return "%g" % x


def unsigned(dim: int) -> int:
    return dim + (1 << 64) if dim < 0 else dim


def escaped(data: bytes, special: bytes = b"%:, ") -> str:
    """The bytes as text; those that aren't printable ASCII, or are special, as %xx."""
    return "".join(chr(c) if 0x20 <= c < 0x7F and c not in special else f"%{c:02x}" for c in data)


def shown_dim(dim: int) -> int:
    """Dimensions are written counting from 1."""
    return (unsigned(dim) + 1) & ((1 << 64) - 1)


def text_line(vec, src: str | None, feats: dict[int, bytes] | None = None) -> str:
    cells = [f"{shown_dim(d)}:{escaped(feats[d]) if feats and d in feats else ''}:{g6(v)}" for d, v in vec]
    return ",".join(cells) + (f" # {src}" if src else "")


def libsvm_line(vec, label: float, src: str | None) -> str:
    return f"{g6(label)} " + "".join(f"{shown_dim(d)}:{g6(v)} " for d, v in vec) + (f"# {src}" if src else "")


def json_record(vec, src: str | None, feats: dict[int, bytes] | None = None) -> str:
    import json

    parts = [f'"dim":[{",".join(str(shown_dim(d)) for d, _ in vec)}]', f'"val":[{",".join(g6(v) for _, v in vec)}]']
    if feats is not None:
        parts.append(f'"feat":[{",".join(chr(34) + escaped(feats.get(d, b""), bytes([37, 34, 92])) + chr(34) for d, _ in vec)}]')
    parts.append(f'"src":{json.dumps(src or "")}')
    return "{" + ",".join(parts) + "}"


def cluto_line(vec) -> str:
    return " ".join(f"{shown_dim(d)} {g6(v)}" for d, v in vec)


def pairs(vec) -> list[tuple[int, float]]:
    """(dim, value) of a vector's entries, the values as 32-bit floats."""
    return [(e["dim"], float(np.float32(e["val"]))) for e in vec or ()]
