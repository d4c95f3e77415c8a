"""The 64-bit feature hash, as a Column expression and over NumPy buffers.

The default is the MurmurHash2 variant that builds 64 bits from two 32-bit lanes; the
alternative is the first eight bytes of MD5, read as a little-endian integer.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

M = 0x5BD1E995
SEED = 0x12345678
LABEL_SEED = 0xC0D3BAB3
LOW = 0xFFFFFFFF
ALGORITHMS = ("murmur", "md5")


def rehash_constants(n: int) -> list[int]:
    """R_0 .. R_n: XORing a dimension with R_k gives its k-th alternative hash.
    R_0 is 0; the others are pairs of outputs of a 48-bit congruential generator."""
    x, out = 0xBABEC0DEDEAD, [0]
    for _ in range(n):
        halves = []
        for _ in range(2):
            x = (x * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
            halves.append(x >> 17)
        out.append(((halves[0] << 32) + halves[1]) & ((1 << 64) - 1))
    return out


def signed64(x: int) -> int:
    """The bigint with these 64 bits."""
    return x - (1 << 64) if x >> 63 else x


def mask_of(bits: int) -> int:
    """The bigint mask that keeps `bits` bits."""
    return signed64((1 << bits) - 1)


# ---- NumPy ---------------------------------------------------------------


def _lanes(rows: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the rows of an (n, size) matrix of bytes."""
    n, whole = len(rows), size // 4
    m = np.uint32(M)
    h1, h2 = np.full(n, (seed ^ size) & LOW, np.uint32), np.zeros(n, np.uint32)
    if whole:
        words = np.ascontiguousarray(rows[:, : 4 * whole]).view("<u4")
        for b in range(whole):
            k = words[:, b] * m
            k = (k ^ (k >> np.uint32(24))) * m
            if b % 2 == 0:
                h1 = (h1 * m) ^ k
            else:
                h2 = (h2 * m) ^ k
    if size % 4:
        tail = np.zeros(n, np.uint32)
        for b in range(size % 4):
            tail |= rows[:, 4 * whole + b].astype(np.uint32) << np.uint32(8 * b)
        h2 = (h2 ^ tail) * m
    h1 = (h1 ^ (h2 >> np.uint32(18))) * m
    h2 = (h2 ^ (h1 >> np.uint32(22))) * m
    h1 = (h1 ^ (h2 >> np.uint32(17))) * m
    h2 = (h2 ^ (h1 >> np.uint32(19))) * m
    return (h1.astype(np.uint64) << np.uint64(32)) | h2.astype(np.uint64)


def hash_slices(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, algorithm: str = "murmur", seed: int = SEED) -> np.ndarray:
    """uint64 hashes of the slices [start, start + length) of a uint8 buffer."""
    out = np.empty(len(start), np.uint64)
    if algorithm == "md5":
        raw = buffer.tobytes()
        for k, (s, n) in enumerate(zip(start.tolist(), length.tolist())):
            out[k] = int.from_bytes(hashlib.md5(raw[s : s + n]).digest()[:8], "little")
        return out
    # 16 bits are sorted by radix; longer slices are few
    order = np.argsort(np.minimum(length, 0xFFFF).astype(np.uint16), kind="stable")
    long = np.searchsorted(length[order], 0xFFFF) if len(length) and length.max() > 0xFFFF else len(order)
    order[long:] = order[long:][np.argsort(length[order[long:]], kind="stable")]
    ordered = length[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    for size, lo, hi in zip(ordered[first].tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        step = max(1, (1 << 22) // max(size, 1))
        for at in range(lo, hi, step):
            ids = order[at : min(at + step, hi)]
            rows = buffer[start[ids][:, None] + np.arange(size)]
            out[ids] = _lanes(rows, size, seed)
    return out


def hash_bytes(data: bytes, algorithm: str = "murmur", seed: int = SEED) -> int:
    """The hash of one byte string."""
    b = np.frombuffer(data, np.uint8)
    return int(hash_slices(b, np.array([0]), np.array([len(b)]), algorithm, seed)[0])


# ---- Catalyst ------------------------------------------------------------


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a lambda's variable, not a copy of its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _times_m(x: Column) -> Column:
    return (x * F.lit(M)).bitwiseAND(F.lit(LOW))


def _little_endian(digits: Column, first: Column, count: int) -> Column:
    """The integer of `count` bytes from byte `first` of a hex string, lowest byte first."""
    parts = [F.substring(digits, (first + i) * 2 + 1, F.lit(2)) for i in reversed(range(count))]
    return F.conv(F.concat(*parts), 16, 10).cast("bigint")


def murmur64(data: Column, seed: int = SEED) -> Column:
    """bigint hash of a binary column (null for null): a fold over its 32-bit words."""

    def lane(digits: Column, whole: Column, parity: int, start: Column) -> Column:
        # sequence() would count down, so an empty lane is cut off instead
        count = F.floor((whole + (1 - parity)) / 2).cast("int")
        blocks = F.slice(F.sequence(F.lit(parity), F.greatest(whole, F.lit(1)) + 1, F.lit(2)), F.lit(1), count)
        words = F.transform(blocks, lambda b: _little_endian(digits, b * 4, 4))

        def step(h: Column, w: Column) -> Column:
            k = _times_m(w)
            return _times_m(h).bitwiseXOR(_times_m(k.bitwiseXOR(F.shiftright(k, 24))))

        return F.aggregate(words, start, step)

    def finish(x: Column) -> Column:
        h1, h2 = x["h1"], x["h2"]

        def three(h1: Column, h2: Column) -> Column:
            return let(
                F.struct(h1.alias("a"), _times_m(h2.bitwiseXOR(F.shiftright(h1, 22))).alias("b")),
                lambda y: let(
                    F.struct(_times_m(y["a"].bitwiseXOR(F.shiftright(y["b"], 17))).alias("c"), y["b"].alias("b")),
                    lambda z: F.shiftleft(z["c"], 32).bitwiseOR(_times_m(z["b"].bitwiseXOR(F.shiftright(z["c"], 19)))),
                ),
            )

        return let(
            F.struct(_times_m(h1.bitwiseXOR(F.shiftright(h2, 18))).alias("h1"), h2.alias("h2")), lambda y: three(y["h1"], y["h2"])
        )

    def whole_hash(digits: Column) -> Column:
        size = F.floor(F.length(digits) / 2).cast("int")
        whole = F.floor(size / 4).cast("int")
        h1 = lane(digits, whole, 0, size.cast("bigint").bitwiseXOR(F.lit(seed).cast("bigint")))
        h2 = lane(digits, whole, 1, F.lit(0).cast("bigint"))
        tail = F.when(size % 4 == 1, _little_endian(digits, whole * 4, 1)).when(size % 4 == 2, _little_endian(digits, whole * 4, 2))
        tail = tail.when(size % 4 == 3, _little_endian(digits, whole * 4, 3))
        return let(
            F.struct(h1.alias("h1"), h2.alias("h2"), tail.alias("t")),
            lambda x: finish(F.struct(x["h1"].alias("h1"), F.when(x["t"].isNull(), x["h2"]).otherwise(_times_m(x["h2"].bitwiseXOR(x["t"]))).alias("h2"))),
        )

    return let(F.hex(data), lambda digits: F.when(digits.isNotNull(), whole_hash(digits)))


def md5_64(data: Column) -> Column:
    """bigint of the first eight bytes of MD5, lowest byte first."""

    def first_half(d: Column) -> Column:
        high, low = (_little_endian(d, F.lit(at), 4) for at in (4, 0))
        return F.shiftleft(high, 32).bitwiseOR(low)

    return let(F.md5(data), first_half)


def feature_hash(data: Column, algorithm: str = "murmur") -> Column:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no hash named {algorithm!r}")
    return md5_64(data) if algorithm == "md5" else murmur64(data)


def rehash(dim: Column, n: int) -> Column:
    """The n-th alternative hash of a dimension; the 0-th is the dimension."""
    return dim.bitwiseXOR(F.lit(signed64(rehash_constants(n)[n]))) if n else dim
