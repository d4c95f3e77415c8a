"""SQL (DuckDB) for the queries, from the same formulas.

N-grams are kept as hexadecimal strings, so that text and bytes are hashed alike.
"""

from __future__ import annotations

from ..functions.hashing import LABEL_SEED, SEED, M, rehash_constants

P = 1 << 32


def token_grams(source: str, n: int = 1, sort: bool = False) -> str:
    """CTEs toks and grams (row_id, pos, x) from a query that gives (row_id, s)."""
    part = f"t[i + 1 : i + {n}]"
    part = f"list_sort({part})" if sort else part
    return f"""src AS ({source}), toks AS (
  SELECT row_id, list_filter(regexp_split_to_array(s, '[ \\n\\r]+'), lambda w: w <> '') AS t FROM src
), grams AS (
  SELECT row_id, i AS pos, array_to_string({part}, chr(10)) AS g, hex(encode(array_to_string({part}, chr(10)))) AS x
  FROM toks, unnest(range(0, len(t) - {n - 1})) AS u(i)
)"""


def byte_grams(source: str, n: int) -> str:
    return f"""src AS ({source}), raw AS (SELECT row_id, hex(encode(s)) AS h FROM src), grams AS (
  SELECT row_id, i AS pos, substr(h, 2 * i + 1, {2 * n}) AS x FROM raw, unnest(range(0, length(h) // 2 - {n - 1})) AS u(i)
)"""


def little_endian(i: str) -> str:
    h = f"printf('%08X', ({i} + {P}) % {P})"
    return " || ".join(f"substr({h}, {at}, 2)" for at in (7, 5, 3, 1))


def positions(k: int = 0) -> str:
    """A CTE posed like grams: each n-gram with its number, for each shift."""
    return f"""posed AS (
  SELECT row_id, pos, x || {little_endian('(pos + k)')} AS x FROM grams, unnest(range({-k}, {k + 1})) AS v(k)
)"""


def _word(x: str, at: str, n: int) -> str:
    return "('0x' || " + " || ".join(f"substr({x}, ({at} + {b}) * 2 + 1, 2)" for b in reversed(range(n))) + ")::UBIGINT"


def _mix(k: str) -> str:
    return f"((xor((({k}) * {M}) % {P}, ((({k}) * {M}) % {P}) >> 24)) * {M}) % {P}"


def murmur(grams: str = "grams", seed: int = SEED, out: str = "hashed") -> str:
    """A CTE of the distinct n-grams with hi, lo (the hash's halves) and h."""

    def lane(parity: int, start: str) -> str:
        words = f"list_transform(range({parity}, n // 4, 2), lambda b: {_word('x', 'b * 4', 4)})"
        return f"list_reduce(list_prepend({start}, list_transform({words}, lambda k: {_mix('k')})), lambda h, k: xor((h * {M}) % {P}, k))"

    tail = f"CASE n % 4 WHEN 1 THEN {_word('x', 'n - 1', 1)} WHEN 2 THEN {_word('x', 'n - 2', 2)} WHEN 3 THEN {_word('x', 'n - 3', 3)} END"
    step = lambda a, b, s: f"(xor({a}, {b} >> {s}) * {M}) % {P}"
    return f"""{out}_0 AS (SELECT x, length(x) // 2 AS n FROM (SELECT DISTINCT x FROM {grams})),
{out}_1 AS (SELECT x, n, {lane(0, f"xor({seed}::UBIGINT, n::UBIGINT)")} AS a, {lane(1, "0::UBIGINT")} AS b0, {tail} AS t FROM {out}_0),
{out}_2 AS (SELECT x, a, CASE WHEN t IS NULL THEN b0 ELSE (xor(b0, t) * {M}) % {P} END AS b FROM {out}_1),
{out}_3 AS (SELECT x, {step('a', 'b', 18)} AS a, b FROM {out}_2),
{out}_4 AS (SELECT x, a, {step('b', 'a', 22)} AS b FROM {out}_3),
{out}_5 AS (SELECT x, {step('a', 'b', 17)} AS a, b FROM {out}_4),
{out} AS (SELECT x, a AS hi, {step('b', 'a', 19)} AS lo, a * {P}::UBIGINT + {step('b', 'a', 19)} AS h FROM {out}_5)"""


def md5_hash(grams: str = "grams") -> str:
    m = "md5(unhex(x))"
    return f"""hashed AS (SELECT x, ('0x' || {' || '.join(f'substr({m}, {2 * b + 1}, 2)' for b in reversed(range(8)))})::UBIGINT AS h FROM (SELECT DISTINCT x FROM {grams}))"""


def dims(bits: int = 22, grams: str = "grams") -> str:
    """A CTE feats (row_id, pos, dim, sgn, x)."""
    return f"""feats AS (
  SELECT g.row_id, g.pos, (h & {(1 << bits) - 1}::UBIGINT)::BIGINT AS dim, x,
         CASE WHEN (h % {P}) > 0 AND (h % {P}) < {1 << 31} THEN -1.0 ELSE 1.0 END AS sgn
  FROM {grams} g JOIN hashed USING (x)
)"""


COUNTS = "counts AS (SELECT row_id, dim, count(*)::DOUBLE AS val FROM feats GROUP BY row_id, dim)"
TOTALS = "SELECT row_id, dim, val FROM counts"


def counts(source: str, n: int = 1, bits: int = 22, sort: bool = False) -> str:
    return f"WITH {token_grams(source, n, sort)}, {murmur()}, {dims(bits)}, {COUNTS}"


def label_hash(x: str) -> str:
    """A whole statement's CTEs for the label hash of the hex strings of CTE `grams`."""
    return murmur("grams", LABEL_SEED)


def rehash_literal(k: int) -> str:
    return f"{rehash_constants(k)[k]}::UBIGINT"
