"""Configuration: one frozen record, its checks, and a reader of configuration files."""

from __future__ import annotations

import dataclasses
import logging
import re
from dataclasses import dataclass
from pathlib import Path

from .functions.ngrams import delimiter_bytes

log = logging.getLogger("hashloom")

GROUPS = {
    "input": ("input_format", "chunk_size", "decode_str", "fasta_regex", "lines_regex", "reverse_str", "stoptoken_file"),
    "features": (
        *("ngram_len", "granularity", "token_delim", "ngram_pos", "pos_shift", "ngram_blend", "ngram_sort", "vect_embed", "vect_norm"),
        *("vect_sign", "thres_low", "thres_high", "hash_bits", "explicit_hash", "hash_file", "tfidf_file"),
    ),
    "filter": ("dim_reduce", "dim_num", "bloom_num"),
    "output": ("output_format", "skip_null"),
}
_CHOICES = {
    "granularity": ("tokens", "bytes"),
    "vect_embed": ("cnt", "bin", "tfidf"),
    "vect_norm": ("none", "l1", "l2"),
    "dim_reduce": ("none", "simhash", "minhash", "bloom"),
    "hash_algorithm": ("murmur", "md5"),
    "sign_mode": ("reference", "aligned"),
}
#: What an unknown name falls back to, with a warning.
_FALLBACK = {"granularity": "bytes", "vect_embed": "cnt", "vect_norm": "none", "dim_reduce": "none"}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    input_format: str = "lines"
    chunk_size: int = 256
    decode_str: bool = False
    fasta_regex: str = r" (\+|-)?[0-9]+"
    lines_regex: str = r"^(\+|-)?[0-9]+"
    reverse_str: bool = False
    stoptoken_file: str = ""
    ngram_len: int = 1
    granularity: str = "tokens"
    token_delim: str = "%20%0a%0d"
    ngram_pos: bool = False
    pos_shift: int = 0
    ngram_blend: bool = False
    ngram_sort: bool = False
    vect_embed: str = "cnt"
    vect_norm: str = "none"
    vect_sign: bool = False
    thres_low: float = 0.0
    thres_high: float = 0.0
    hash_bits: int = 22
    explicit_hash: bool = False
    hash_file: str = ""
    tfidf_file: str = "tfidf.fv"
    dim_reduce: str = "none"
    dim_num: int = 32
    bloom_num: int = 2
    output_format: str = "libsvm"
    skip_null: bool = False
    #: Beyond the published options: the hash, how signs meet their dims, and whether to repeat quirks.
    hash_algorithm: str = "murmur"
    sign_mode: str = "reference"
    strict_compat: bool = False

    def __post_init__(self):
        for f in dataclasses.fields(self):
            object.__setattr__(self, f.name, _coerce(f.name, f.type, getattr(self, f.name)))
        for name, known in _CHOICES.items():
            value = getattr(self, name).lower()
            if value not in known:
                if name not in _FALLBACK:
                    raise ConfigError(f"{name} must be one of {', '.join(known)}")
                log.warning("unknown %s %r, using %r", name, value, _FALLBACK[name])
                value = _FALLBACK[name]
            object.__setattr__(self, name, value)
        if self.ngram_len < 1:
            raise ConfigError("ngram_len must be at least 1")
        if self.granularity == "tokens" and not self.token_delim:
            raise ConfigError("tokens need delimiters (token_delim)")
        if self.stoptoken_file and not self.token_delim:
            raise ConfigError("stop tokens need delimiters (token_delim)")
        if self.thres_low and self.thres_high and self.thres_low > self.thres_high:
            raise ConfigError("thres_low is above thres_high")
        if self.explicit_hash and self.hash_file:
            raise ConfigError("explicit_hash and hash_file exclude each other")
        if not 1 <= self.hash_bits <= 64:
            raise ConfigError("hash_bits must lie in 1 .. 64")
        if self.pos_shift < 0:
            raise ConfigError("pos_shift must not be negative")
        if self.dim_num < 1 or self.bloom_num < 1 or self.chunk_size < 1:
            raise ConfigError("dim_num, bloom_num and chunk_size must be at least 1")

    @property
    def delims(self) -> bytes:
        return delimiter_bytes(self.token_delim)

    def replace(self, **changes) -> Config:
        return dataclasses.replace(self, **changes)

    def to_text(self) -> str:
        """The configuration in the syntax that `parse` reads."""
        out = []
        for group, names in GROUPS.items():
            out.append(f"{group} = {{")
            for n in names:
                v = getattr(self, n)
                shown = str(v).lower() if isinstance(v, bool) else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(v, str) else repr(v)
                out.append(f"\t{n} = {shown};")
            out.append("};")
        return "\n".join(out) + "\n"


def _coerce(name: str, kind: str, value):
    """Numbers and truth values turn into each other; strings stay strings."""
    if kind == "str":
        if not isinstance(value, str):
            raise ConfigError(f"{name} must be a string")
        return value
    if isinstance(value, str):
        raise ConfigError(f"{name} must not be a string")
    return {"int": int, "float": float, "bool": bool}[kind](value)


_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\])*")
    |(?P<float>[-+]?(?:\d+\.\d*|\.\d+)(?:[eE][-+]?\d+)?|[-+]?\d+[eE][-+]?\d+)|(?P<hex>0[xX][0-9a-fA-F]+L*)
    |(?P<int>[-+]?\d+L*)|(?P<name>[A-Za-z*][-A-Za-z0-9_*]*)|(?P<sign>[={}:;,])""",
    re.S | re.X,
)


def parse(text: str) -> dict[str, dict]:
    """{group: {name: value}} of a configuration text: groups in braces, settings with = or
    :, ended by ; or , or nothing; comments with #, // or /* */; adjacent strings join."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConfigError(f"configuration, line {text.count(chr(10), 0, at) + 1}: {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup != "space":
            tokens.append((m.lastgroup, m.group()))
    out: dict[str, dict] = {}
    k = 0

    def peek() -> tuple[str, str]:
        return tokens[k] if k < len(tokens) else ("end", "")

    def value():
        nonlocal k
        kind, s = peek()
        k += 1
        if kind == "string":
            parts = [s]
            while peek()[0] == "string":
                parts.append(peek()[1])
                k += 1
            simple = {"n": "\n", "r": "\r", "t": "\t", "f": "\f"}
            return "".join(re.sub(r"\\(x[0-9a-fA-F]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 3 else simple.get(m[1], m[1]), p[1:-1]) for p in parts)
        if kind == "float":
            return float(s)
        if kind == "hex":
            return int(s.rstrip("L"), 16)
        if kind == "int":
            return int(s.rstrip("L"))
        if kind == "name" and s.lower() in ("true", "false"):
            return s.lower() == "true"
        raise ConfigError(f"configuration: no value at {s!r}")

    def settings(into: dict, inner: bool) -> None:
        nonlocal k
        while True:
            kind, s = peek()
            if kind == "end" and not inner or s == "}" and inner:
                k += 1
                return
            if kind != "name":
                raise ConfigError(f"configuration: no name at {s!r}")
            k += 1
            if peek()[1] not in ("=", ":"):
                raise ConfigError(f"configuration: nothing is assigned to {s}")
            k += 1
            if peek()[1] == "{":
                k += 1
                settings(into.setdefault(s, {}), True)
            else:
                into[s] = value()
            while peek()[1] in (";", ","):
                k += 1

    settings(out, False)
    return out


def load(path: str | Path, **overrides) -> Config:
    """The configuration in a file, which must set granularity and token_delim and must not
    have the old ngram_delim."""
    groups = parse(Path(path).read_text())
    found = {n: v for g in groups.values() if isinstance(g, dict) for n, v in g.items()}
    if "ngram_delim" in found:
        raise ConfigError("ngram_delim is no longer an option; use granularity and token_delim")
    for needed in ("granularity", "token_delim"):
        if needed not in groups.get("features", {}):
            raise ConfigError(f"the configuration lacks features.{needed}")
    known = {n for names in GROUPS.values() for n in names} | {"hash_algorithm", "sign_mode", "strict_compat"}
    for n in sorted(set(found) - known):
        log.warning("unknown option %s", n)
    return Config(**{**{n: v for n, v in found.items() if n in known}, **overrides})
