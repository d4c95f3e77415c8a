"""n-grams as Column expressions: arrays of binary, in the order of extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import let


def delimiter_bytes(spec: str) -> bytes:
    """The distinct bytes that a delimiter specification names, in order; %XX is the byte
    with that hexadecimal code."""
    raw, out, i = spec.encode("utf-8"), set(), 0
    while i < len(raw):
        if raw[i : i + 1] == b"%" and re.fullmatch(rb"[0-9a-fA-F]{2}", raw[i + 1 : i + 3]):
            out.add(int(raw[i + 1 : i + 3], 16))
            i += 3
        else:
            out.add(raw[i])
            i += 1
    return bytes(sorted(out))


def _class_of(delims: bytes) -> str:
    if max(delims) >= 0x80:
        raise ValueError("as an expression, tokens need ASCII delimiters; the Arrow engine takes any byte")
    return "[" + "".join(f"\\x{b:02x}" for b in delims) + "]+"


def tokens(text: Column, delims: bytes) -> Column:
    """array<string> of the runs without delimiters."""
    return F.filter(F.split(text, _class_of(delims)), lambda t: t != "")


def _slices(size: Column, n: int) -> Column:
    """0 .. size - n; none where size < n (sequence() itself would count down)."""
    return F.slice(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), F.lit(1), F.greatest(size - n + 1, F.lit(0)))


def token_ngrams(toks: Column, n: int, delims: bytes, sort: bool = False) -> Column:
    """Runs of n tokens, joined by the smallest delimiter; `sort` orders the tokens in each."""
    if n == 1:
        return F.transform(toks, lambda t: t.cast("binary"))
    glue = chr(min(delims))

    def gram(x: Column, i: Column) -> Column:
        part = F.slice(x, i + 1, F.lit(n))
        return F.array_join(F.array_sort(part) if sort else part, glue).cast("binary")

    return let(toks, lambda x: F.transform(_slices(F.size(x), n), lambda i: gram(x, i)))


def byte_ngrams(data: Column, n: int, sort: bool = False) -> Column:
    """All substrings of n bytes; `sort` orders the bytes in each, those from 0x80 first."""

    def gram(x: Column, i: Column) -> Column:
        part = F.substring(x, i + 1, F.lit(n))
        if not sort or n == 1:
            return part
        pairs = F.regexp_extract_all(F.hex(part), F.lit("(..)"), F.lit(1))
        key = F.transform(pairs, lambda p: F.struct((F.conv(p, 16, 10).cast("int") + 128) % 256, p.alias("p")))
        return F.unhex(F.array_join(F.transform(F.array_sort(key), lambda s: s["p"]), ""))

    return let(data, lambda x: F.transform(_slices(F.octet_length(x), n), lambda i: gram(x, i)))


def positioned(grams: Column, shift: int = 0) -> Column:
    """Each n-gram followed by its number, shifted by -shift .. shift, as four bytes
    (lowest first)."""

    def suffix(i: Column) -> Column:
        h = F.lpad(F.hex(i.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
        return F.unhex(F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)]))

    def shifted(s: int) -> Column:
        return F.transform(grams, lambda g, i: F.concat(g, suffix(i + s)))

    return F.concat(*[shifted(s) for s in range(-shift, shift + 1)])


def ngram_parts(
    data: Column, granularity: str, n: int, delims: bytes = b"", sort: bool = False, pos: bool = False, shift: int = 0, blend: bool = False
) -> list[Column]:
    """One array of n-grams for each length: of n, and with `blend` of 1 .. n-1 too.
    The lengths are counted apart and added, so a signed vector needs them apart."""
    out = []
    for size in [n, *range(1, n)] if blend else [n]:
        grams = byte_ngrams(data, size, sort) if granularity == "bytes" else token_ngrams(tokens(data.cast("string"), delims), size, delims, sort)
        out.append(positioned(grams, shift) if pos else grams)
    return out
