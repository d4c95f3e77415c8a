"""Struct arrays of sparse vectors in MAT-files of version 5."""

from __future__ import annotations

import struct
from collections.abc import Iterable

_INT8, _INT32, _UINT16, _UINT32, _DOUBLE, _MATRIX = 1, 5, 4, 6, 9, 14
_CELL, _STRUCT, _CHAR, _SPARSE, _FLOAT64 = 1, 2, 4, 5, 6


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _matrix(cls: int, dims: tuple[int, ...], name: str, *parts: bytes, nzmax: int = 0) -> bytes:
    head = _element(_UINT32, struct.pack("<II", cls, nzmax))
    head += _element(_INT32, struct.pack(f"<{len(dims)}i", *dims)) + _element(_INT8, name.encode())
    body = head + b"".join(parts)
    return struct.pack("<II", _MATRIX, len(body)) + body


def sparse(dims: list[int], vals: list[float], rows: int) -> bytes:
    n = len(dims)
    ir = _element(_INT32, struct.pack(f"<{n}i", *[d & 0x7FFFFFFF for d in dims]))
    jc = _element(_INT32, struct.pack("<2i", 0, n))
    return _matrix(_SPARSE, (rows, 1), "", ir, jc, _element(_DOUBLE, struct.pack(f"<{n}d", *vals)), nzmax=max(n, 1))


def text(s: str) -> bytes:
    raw = s.encode("utf-16-le")
    return _matrix(_CHAR, (1, len(raw) // 2), "", _element(_UINT16, raw))


def number(x: float) -> bytes:
    return _matrix(_FLOAT64, (1, 1), "", _element(_DOUBLE, struct.pack("<d", x)))


def cell(items: list[str]) -> bytes:
    return _matrix(_CELL, (1, len(items)), "", *[text(s) for s in items])


def write_mat(path: str, records: Iterable[tuple[list[int], list[float], str, float, list[str] | None]], bits: int, with_feats: bool = False) -> int:
    """Writes (dims, values, src, label, n-grams) as the 1 x n struct array fvec with the
    fields data, src, label (and feat); gives n.  Sizes are filled in at the end."""
    if bits > 31:
        raise ValueError("a MAT-file holds at most 31 bits of dimensions")
    fields = ["data", "src", "label", *(["feat"] if with_feats else [])]
    with open(path, "wb") as f:
        f.write(b"MATLAB 5.0 MAT-file, sparse string vectors".ljust(116) + b"\0" * 8 + struct.pack("<HH", 0x0100, 0x4D49))
        start = f.tell()
        f.write(struct.pack("<II", _MATRIX, 0))
        f.write(_element(_UINT32, struct.pack("<II", _STRUCT, 0)))
        dims_at = f.tell() + 8
        f.write(_element(_INT32, struct.pack("<2i", 1, 0)) + _element(_INT8, b"fvec"))
        f.write(struct.pack("<HHi", _INT32, 4, 8) + _element(_INT8, b"".join(x.encode().ljust(8, b"\0") for x in fields)))
        n = 0
        for dims, vals, src, label, feats in records:
            f.write(sparse(dims, vals, 1 << bits if bits < 31 else 0x7FFFFFFF) + text(src) + number(label))
            if with_feats:
                f.write(cell([s.replace("%", "%%") for s in feats or []]))
            n += 1
        end = f.tell()
        f.seek(start + 4)
        f.write(struct.pack("<I", end - start - 8))
        f.seek(dims_at + 4)
        f.write(struct.pack("<i", n))
    return n
