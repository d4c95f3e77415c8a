"""Preprocessing of strings, on binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import hash_bytes, let
from .ngrams import _class_of


def decode_bytes(data: bytes, strict: bool = False) -> bytes:
    """%XX becomes the byte with that code; a digit that isn't hexadecimal counts as 0, a
    missing one too, and a plus sign stays.  A percent sign at the very end stays.  With
    `strict` a decoded zero byte ends the string, as in the published tool."""

    def digit(at: int) -> int:
        c = data[at : at + 1]
        return int(c, 16) if c and c in b"0123456789abcdefABCDEF" else 0

    out, i = bytearray(), 0
    while i < len(data):
        if data[i] == 0x25 and i + 1 < len(data):
            out.append(digit(i + 1) * 16 + digit(i + 2))
            i += 3
            if strict and out[-1] == 0:
                break
        else:
            out.append(data[i])
            i += 1
    return bytes(out)


def uri_decode(data: Column) -> Column:
    """`decode_bytes` as an expression."""
    h = F.hex(data)
    # Byte pairs from the left: an escape takes three bytes, anything else one.
    pieces = F.regexp_extract_all(h, F.lit("\\G(25(?:..){1,2}|..)"), F.lit(1))

    def one(p: Column) -> Column:
        def digit(at: int) -> Column:
            c = F.substring(p, at, 2)
            return F.when(c.rlike("^(3[0-9]|[46][1-6])$"), F.unhex(c).cast("string")).otherwise(F.lit("0"))

        return F.when(F.length(p) > 2, F.concat(digit(3), digit(5))).otherwise(p)

    return F.unhex(F.array_join(F.transform(pieces, one), ""))


def reverse_bytes(data: Column) -> Column:
    """The bytes in reverse order (reverse() itself would reverse characters)."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))), ""))


def stop_hashes(lines: list[bytes], algorithm: str = "murmur", strict: bool = False) -> frozenset[int]:
    """Hashes of stop tokens, one a line, URI-encoded, blank lines skipped.  With `strict` a
    token with escapes is hashed over its length before decoding, as in the published tool, and
    so never matches."""
    out = set()
    for line in lines:
        line = line.rstrip(b"\r\n")
        if line:
            token = decode_bytes(line)
            out.add(hash_bytes(token + b"\0" * (len(line) - len(token)) if strict else token, algorithm))
    return frozenset(out)


def stop_filter(data: Column, stop: list[str], delims: bytes) -> Column:
    """The text without the tokens that `stop` names; all delimiters stay."""
    if not stop:
        return data
    kind = _class_of(delims)[:-1]
    pieces = F.regexp_extract_all(data.cast("string"), F.lit(f"({kind}|[^{kind[1:]}+)"), F.lit(1))
    names = F.array(*[F.lit(s) for s in sorted(set(stop))])
    return let(pieces, lambda p: F.array_join(F.filter(p, lambda t: ~F.array_contains(names, t)), "")).cast("binary")


def trim_blanks(text: Column) -> Column:
    """Without the ASCII white space at both ends."""
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def strip_newline(text: Column) -> Column:
    """Without the line feeds and carriage returns at the end."""
    return F.regexp_replace(text, r"[\r\n]+\z", "")
