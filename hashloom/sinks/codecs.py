"""Gzip text files of single vectors (IDF weights) and of feature dictionaries."""

from __future__ import annotations

import gzip
import re

from pyspark.sql import DataFrame, SparkSession

from .formats import escaped, unsigned

_HEAD = re.compile(r"fvec: len=(\d+), total=(\d+), label=(\S+), src=(.*)")
_CELL = re.compile(r"  feat=([0-9a-fA-F]{16}):(\S+)")
_BIN = re.compile(r"  bin=([0-9a-fA-F]{16}): ?(.*)")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def save_vector(path: str, entries: list[tuple[int, float]], total: int = 0, label: float = 0.0, src: str = "") -> None:
    with gzip.open(path, "wt", compresslevel=9) as f:
        f.write(f"fvec: len={len(entries)}, total={total}, label={label:12.10f}, src={src}\n")
        f.writelines(f"  feat={unsigned(d):016x}:{v:12.10f}\n" for d, v in entries)


def load_vector(path: str) -> tuple[list[tuple[int, float]], dict]:
    with gzip.open(path, "rt") as f:
        m = _HEAD.match(f.readline())
        if not m:
            raise ValueError(f"{path} holds no vector")
        entries = [(_signed(int(c[1], 16)), float(c[2])) for c in map(_CELL.match, f) if c]
    if len(entries) != int(m[1]):
        raise ValueError(f"{path} holds {len(entries)} entries, not {m[1]}")
    return entries, {"total": int(m[2]), "label": float(m[3]), "src": m[4]}


def save_weights(path: str, idf: DataFrame) -> None:
    """IDF weights (dim, idf), by dim read as unsigned."""
    save_vector(path, sorted(((r.dim, r.idf) for r in idf.toLocalIterator()), key=lambda e: unsigned(e[0])))


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(load_vector(path)[0], "dim bigint, idf float")


def save_dictionary(path: str, entries: DataFrame) -> None:
    """A feature dictionary (dim, feat), by dim read as unsigned."""
    rows = sorted(((unsigned(r.dim), bytes(r.feat)) for r in entries.select("dim", "feat").toLocalIterator()))
    with gzip.open(path, "wt", compresslevel=9) as f:
        f.write(f"fhash: len={len(rows)}\n")
        f.writelines(f"  bin={d:016x}: {escaped(b)}\n" for d, b in rows)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    def raw(s: str) -> bytes:
        # a byte from 0x80 may be written with its sign extended, as %ffffffXX
        return re.sub(rb"%(?:ffffff)?([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), s.encode("latin-1"))

    with gzip.open(path, "rt") as f:
        if not f.readline().startswith("fhash: len="):
            raise ValueError(f"{path} holds no dictionary")
        rows = [(_signed(int(m[1], 16)), raw(m[2].rstrip("\n"))) for m in map(_BIN.match, f) if m]
    return spark.createDataFrame(rows, "dim bigint, feat binary")
