"""Sparse vectors as Column expressions.

A vector is array<struct<dim:bigint, val:float>>, sorted by dim.  Values are floats after
each operation; sums are taken in double.  A value of at most 1e-9 in size, or one that is no
number, counts as zero and `sparsify` drops it.  A null vector gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import let, mask_of, rehash_constants, signed64

VECTOR = "array<struct<dim:bigint,val:float>>"
ZERO = 1e-9


def _entry(dim: Column, val: Column) -> Column:
    return F.struct(dim.cast("bigint").alias("dim"), val.cast("float").alias("val"))


def _map(v: Column, f) -> Column:
    return F.transform(v, lambda e: _entry(e["dim"], f(e["val"])))


def _total(v: Column, f) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, e: s + f(e["val"].cast("double")))


def _over(v: Column, n: Column, possible: Column) -> Column:
    """v's values over n; no entries where that isn't possible, null for null."""
    return F.when(possible, _map(v, lambda y: y.cast("double") / n)).otherwise(F.when(v.isNotNull(), empty_vector()))


def empty_vector() -> Column:
    return F.array().cast(VECTOR)


def _runs(x: Column, dim, total) -> Column:
    """An entry for each run of equal dims in an array."""
    n = F.size(x)
    # where the runs begin, and at last where they end
    edges = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (dim(F.get(x, i)) != dim(F.get(x, i - 1))))

    def one(s: Column) -> Column:
        return F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda at, k: _entry(dim(F.get(x, at)), total(x, at, F.get(s, k + 1))))

    return F.when(n > 0, let(edges, one)).otherwise(empty_vector())


def _summed(entries: Column) -> Column:
    """The vector of an array of entries with dims in order; those of one dim are added up."""

    def total(x: Column, at: Column, end: Column) -> Column:
        several = F.aggregate(F.slice(x, at + 1, end - at), F.lit(0.0), lambda t, e: t + e["val"].cast("double"))
        return F.when(end - at == 1, F.get(x, at)["val"].cast("double")).otherwise(several)

    return let(entries, lambda x: F.when(x.isNotNull(), _runs(x, lambda e: e["dim"], total)))


def vector_of(dims: Column, vals: Column | None = None, sign_mode: str = "aligned") -> Column:
    """A vector that counts an array of dims (or sums their vals).

    sign_mode "reference" pairs the i-th value with the i-th smallest dim, as the
    published results have it; "aligned" leaves each value with its own dim.
    """
    if vals is None:
        return let(F.sort_array(dims), lambda x: F.when(x.isNotNull(), _runs(x, lambda d: d, lambda x, at, end: end - at)))
    if sign_mode == "aligned":
        return _summed(F.sort_array(F.arrays_zip(dims.alias("dim"), vals.alias("val"))))
    return _summed(F.zip_with(F.sort_array(dims), vals, lambda d, v: F.struct(d.alias("dim"), v.alias("val"))))


def sparsify(v: Column) -> Column:
    return F.filter(v, lambda e: e["val"].isNotNull() & ~F.isnan(e["val"]) & (F.abs(e["val"].cast("double")) > ZERO))


def add(a: Column, b: Column) -> Column:
    """The sum of two vectors; entries that cancel out stay, with 0."""
    return _summed(F.sort_array(F.concat(a, b)))


def times(a: Column, b: Column) -> Column:
    """The entry-wise product, on the dims that both have."""
    return let(
        F.map_from_entries(b),
        lambda m: F.transform(
            F.filter(a, lambda e: F.map_contains_key(m, e["dim"])),
            lambda e: _entry(e["dim"], e["val"].cast("double") * F.get(F.array(F.element_at(m, e["dim"])), F.lit(0)).cast("double")),
        ),
    )


def dot(a: Column, b: Column) -> Column:
    """The inner product, a double."""
    return let(
        F.map_from_entries(b),
        lambda m: F.aggregate(
            a, F.lit(0.0), lambda s, e: s + F.when(F.map_contains_key(m, e["dim"]), (e["val"] * F.element_at(m, e["dim"])).cast("double")).otherwise(0.0)
        ),
    )


def mul(v: Column, s) -> Column:
    """The vector times a number or column."""
    s = s if isinstance(s, Column) else F.lit(float(s))
    return _map(v, lambda x: x.cast("double") * s.cast("float").cast("double"))


def log2(v: Column) -> Column:
    """log2 of each value: minus infinity for 0, not a number for less."""
    def one(x: Column) -> Column:
        return F.when(x > 0, F.log2(x.cast("double"))).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))

    return _map(v, one)


def invert(v: Column) -> Column:
    """1 / value; infinity for 0."""
    return _map(v, lambda x: F.when(x == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), x.cast("double"))))


def binarize(v: Column) -> Column:
    """1 for each stored entry, also for one whose value is 0."""
    return _map(v, lambda x: F.lit(1.0))


def norm(v: Column, kind: str) -> Column:
    """The vector over its l1 or l2 norm ("none" leaves it); all zeros give no entries."""
    if kind == "none":
        return v
    if kind not in ("l1", "l2"):
        raise ValueError(f"no norm named {kind!r}")

    def size(x: Column) -> Column:
        return _total(x, F.abs) if kind == "l1" else F.sqrt(_total(x, lambda y: y * y))

    return let(v, lambda x: let(size(x), lambda n: _over(x, n, n > 0)))


def threshold(v: Column, low: float = 0.0, high: float = 0.0) -> Column:
    """Without the values below low or above high; a bound of 0 is off."""
    if low:
        v = F.filter(v, lambda e: ~(e["val"].cast("double") < float(low)))
    if high:
        v = F.filter(v, lambda e: ~(e["val"].cast("double") > float(high)))
    return sparsify(v) if low or high else v


def embed(v: Column, kind: str) -> Column:
    """"cnt" leaves the counts, "bin" sets them to 1, "tf" divides by their sum."""
    if kind == "cnt":
        return v
    if kind == "bin":
        return binarize(v)
    if kind == "tf":
        return let(v, lambda x: let(_total(x, lambda y: y), lambda n: _over(x, n, n != 0)))
    raise ValueError(f"no embedding named {kind!r}")


def equals(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Whether two vectors have the same dims and values within the tolerance."""

    def both(x: Column) -> Column:
        same = F.transform(x["a"], lambda e: e["dim"]) == F.transform(x["b"], lambda e: e["dim"])
        near = F.forall(F.zip_with(x["a"], x["b"], lambda p, q: F.abs(p["val"] - q["val"])), lambda d: d <= tolerance)
        return F.when(same, near).otherwise(same)

    return let(F.struct(a.alias("a"), b.alias("b")), both)


def simhash(v: Column, bits: int, num: int = 32) -> Column:
    """Bit j is 1 where the entries whose dim has bit j outweigh the others."""
    num = min(num, bits)

    def side(x: Column, j: Column) -> Column:
        def step(s: Column, e: Column) -> Column:
            inside = F.call_function("shiftright", e["dim"], j).bitwiseAND(F.lit(1)) == 1
            return (s + F.when(inside, e["val"]).otherwise(-e["val"])).cast("float")

        return F.aggregate(x, F.lit(0.0).cast("float"), step)

    def rows(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda j: F.struct(j.cast("bigint").alias("dim"), side(x, j).alias("s")))

    return F.transform(F.filter(let(v, rows), lambda r: r["s"] > 0), lambda r: _entry(r["dim"], F.lit(1.0)))


def _unsigned_min(v: Column, constant: int, bits: int) -> Column:
    """The smallest (dim xor constant) kept to `bits` bits; -1 (all bits) without entries."""
    flip = F.lit(-(1 << 63))
    keys = F.transform(v, lambda e: e["dim"].bitwiseXOR(F.lit(signed64(constant))).bitwiseAND(F.lit(mask_of(bits))).bitwiseXOR(flip))
    return F.coalesce(F.array_min(keys).bitwiseXOR(flip), F.lit(-1).cast("bigint"))


def minhash(v: Column, bits: int, num: int = 32) -> Column:
    """The bits of the smallest alternative hash of each round, until there are num."""
    rounds = -(-num // bits)
    constants = rehash_constants(rounds)

    def one(v: Column, r: int) -> Column:
        at = F.sequence(F.lit(0), F.lit(min(bits, num - r * bits) - 1))

        def bits_of(m: Column) -> Column:
            there = F.filter(at, lambda j: F.call_function("shiftright", m, j).bitwiseAND(F.lit(1)) == 1)
            return F.transform(there, lambda j: _entry(j + r * bits, F.lit(1.0)))

        return let(_unsigned_min(v, constants[r], bits), bits_of)

    return let(v, lambda x: F.when(x.isNotNull(), F.concat(*[one(x, r) for r in range(rounds)])))


def _unsigned_mod(x: Column, n: int) -> Column:
    """x mod n, x read as unsigned."""
    return F.pmod(F.pmod(x, F.lit(n)) + F.when(x < 0, F.lit((1 << 64) % n)).otherwise(F.lit(0)), F.lit(n))


def bloom(v: Column, num: int = 32, k: int = 2) -> Column:
    """A Bloom filter of num bits and k alternative hashes over the dims."""
    constants = rehash_constants(max(0, k - 1))[:k]

    def places(x: Column, constant: int) -> Column:
        return F.transform(x, lambda e: _unsigned_mod(e["dim"].bitwiseXOR(F.lit(signed64(constant))), num))

    dims = let(v, lambda x: F.flatten(F.array(*[places(x, c) for c in constants])))
    return F.transform(F.array_sort(F.array_distinct(dims)), lambda d: _entry(d, F.lit(1.0)))


def reduce_dims(v: Column, kind: str, bits: int, num: int = 32, bloom_num: int = 2) -> Column:
    """The named reduction, then `sparsify`."""
    if kind == "simhash":
        v = simhash(v, bits, num)
    elif kind == "minhash":
        v = minhash(v, bits, num)
    elif kind == "bloom":
        v = bloom(v, num, bloom_num)
    elif kind != "none":
        raise ValueError(f"no reduction named {kind!r}")
    return sparsify(v)
