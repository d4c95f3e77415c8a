"""Labels of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import LABEL_SEED, let, murmur64
from .vectors import _unsigned_mod

_NUMBER = r"(?i)^[ \t\n\x0B\f\r]*[+-]?(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"


def as_latin1(data: Column) -> Column:
    """Bytes as a text with a character for each, for what Spark does to text only."""
    return F.decode(data.cast("binary"), "ISO-8859-1")


def from_latin1(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def number_or_hash(text: Column, data: Column | None = None) -> Column:
    """The text as a float where all of it is a decimal number (or inf, or nan); else a hash of
    it (of data, if that is given) modulo 65535."""
    numeric = F.regexp_replace(F.lower(F.trim(text)), "^\\+", "")
    hashed = _unsigned_mod(murmur64(text.cast("binary") if data is None else data, LABEL_SEED), 0xFFFF).cast("float")
    return F.when(text.rlike(_NUMBER), numeric.try_cast("float")).otherwise(hashed)


def regex_label(text: Column, pattern: str) -> Column:
    """struct<label:float, rest:binary>: of the first match of the pattern in the bytes of text; rest is what stands
    after it.  Without a match the label is 0 and the bytes stay.  Where the pattern has
    characters beyond ASCII their UTF-8 bytes are meant."""
    pattern = pattern.encode("utf-8").decode("latin-1")
    plain = as_latin1(text)
    at = F.regexp_instr(plain, F.lit(pattern))

    def one(x: Column) -> Column:
        found = F.regexp_substr(x["t"], F.lit(pattern))
        return F.struct(
            F.when(x["at"] > 0, number_or_hash(found, from_latin1(found))).otherwise(F.lit(0.0)).cast("float").alias("label"),
            from_latin1(F.when(x["at"] > 0, F.substring(x["t"], x["at"] + F.length(found), F.length(x["t"]))).otherwise(x["t"])).alias("rest"),
        )

    return let(F.struct(plain.alias("t"), at.alias("at")), one)


def suffix_label(name: Column) -> Column:
    """Of what follows the last dot of a name, unless that is its first character; of the
    whole name where there is none."""
    return number_or_hash(F.when(name.rlike(r"^.+\."), F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)).otherwise(name)).cast("float")
