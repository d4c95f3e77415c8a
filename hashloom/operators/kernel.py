"""The row-local embedding over Arrow batches, vectorised with NumPy.

It does what the expressions of `functions` say, for any bytes, in one pass over a
batch: preprocess, n-grams, hash, count, scale, reduce.  Nothing in it moves rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..config import Config
from ..functions.hashing import hash_slices, rehash_constants
from ..functions.ngrams import delimiter_bytes
from ..functions.preprocess import decode_bytes

VECTOR_TYPE = pa.list_(pa.struct([("dim", pa.int64()), ("val", pa.float32())]))
_ZERO = 1e-9


def _gather(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, room: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The slices one after the other, each with `room` free bytes after it, and where they begin."""
    total = length + room
    first = np.concatenate([[0], np.cumsum(total)[:-1]]).astype(np.int64) if len(total) else np.zeros(0, np.int64)
    out = np.zeros(int(total.sum()), np.uint8)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(first, length) + inside] = buffer[np.repeat(start, length) + inside]
    return out, first


def slices(batches, most: int = 1 << 20):
    """The rows of the batches in batches of about `most` bytes, or of one longer row, so that
    working memory stays small where strings are long."""
    for b in batches:
        rows = max(1, b.num_rows * most // max(1, b.nbytes))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _flat(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buffer = np.frombuffer(b"".join(data), np.uint8)
    return buffer, np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


class Grams:
    """Slices of a buffer, each with the row it is from and its number in that row."""

    def __init__(self, buffer, start, length, row, number):
        self.buffer, self.start, self.length, self.row, self.number = buffer, start, length, row, number

    def strings(self) -> list[bytes]:
        raw = self.buffer.tobytes()
        return [raw[s : s + n] for s, n in zip(self.start.tolist(), self.length.tolist())]


class Kernel:
    def __init__(self, config: Config, stop: frozenset[int] = frozenset(), idf: tuple[np.ndarray, np.ndarray] | None = None, counts_only: bool = False, hash_only: bool = False):
        self.c, self.idf, self.counts_only = config, idf, counts_only
        self.delims = delimiter_bytes(config.token_delim)
        self.table = np.zeros(256, bool)
        self.table[list(self.delims)] = True
        self.stop = np.array(sorted(stop), np.uint64)
        self.mask = np.uint64((1 << config.hash_bits) - 1)

    # ---- bytes to bytes

    def preprocess(self, data: list[bytes | None]) -> list[bytes]:
        out = [d or b"" for d in data]
        if self.c.decode_str:
            out = [decode_bytes(d, self.c.strict_compat) if b"%" in d else d for d in out]
        if self.c.reverse_str:
            out = [d[::-1] for d in out]
        if len(self.stop) and len(self.delims):
            out = [self._without_stop(d) for d in out]
        return out

    def _without_stop(self, d: bytes) -> bytes:
        b = np.frombuffer(d, np.uint8)
        if not len(b):
            return d
        inside = ~self.table[b]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        gone = np.isin(hash_slices(b, start, end - start, self.c.hash_algorithm), self.stop)
        keep = np.ones(len(b), bool)
        for s, e in zip(start[gone].tolist(), end[gone].tolist()):
            keep[s:e] = False
        return b[keep].tobytes()

    # ---- bytes to n-grams

    def _tokens(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A buffer in which each token has one delimiter after it, and the tokens' starts,
        ends and rows."""
        n, glue = len(offsets) - 1, min(self.delims)
        ends = np.arange(n) + offsets[1:]
        joined = np.insert(buffer, offsets[1:], glue)
        is_delim = self.table[joined]
        before = np.concatenate([[True], is_delim[:-1]])
        keep = ~(is_delim & before)
        joined[is_delim] = glue
        first = np.flatnonzero(~is_delim & before)
        last = np.flatnonzero(is_delim & ~before)
        size = last - first
        start = np.cumsum(size + 1) - size - 1
        return joined[keep], start, start + size, np.searchsorted(ends, first)

    def grams(self, data: list[bytes], size: int) -> Grams:
        buffer, offsets = _flat(data)
        c = self.c
        if c.granularity == "tokens":
            buffer, start, end, row = self._tokens(buffer, offsets)
            per_row = np.bincount(row, minlength=len(data)) if len(row) else np.zeros(len(data), np.int64)
            if len(start) < size:
                z = np.zeros(0, np.int64)
                return Grams(buffer, z, z, z, z)
            whole = row[: len(row) - size + 1] == row[size - 1 :]
            at = np.flatnonzero(whole)
            g = Grams(buffer, start[at], end[at + size - 1] - start[at], row[at], at - (np.cumsum(per_row) - per_row)[row[at]])
            if c.ngram_sort and size > 1:
                glue = bytes([min(self.delims)])
                g.buffer, o = _flat([glue.join(sorted(s.split(glue))) for s in g.strings()])
                g.start = o[:-1]
            return g
        lengths = np.maximum(np.diff(offsets) - size + 1, 0)
        row = np.repeat(np.arange(len(data)), lengths)
        number = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        start = offsets[row] + number
        if c.ngram_sort and size > 1 and len(start):
            cells = np.sort(buffer[start[:, None] + np.arange(size)].view(np.int8), axis=1).view(np.uint8)
            return Grams(np.ascontiguousarray(cells).reshape(-1), np.arange(len(start)) * size, np.full(len(start), size), row, number)
        return Grams(buffer, start, np.full(len(start), size, np.int64), row, number)

    def parts(self, data: list[bytes]) -> list[Grams]:
        """The n-grams of each length, positions appended, in the order of extraction."""
        c, out = self.c, []
        for size in [c.ngram_len, *range(1, c.ngram_len)] if c.ngram_blend else [c.ngram_len]:
            g = self.grams(data, size)
            if c.ngram_pos:
                plain, first = _gather(g.buffer, g.start, g.length, 4)
                shifts = range(-c.pos_shift, c.pos_shift + 1)
                copies = []
                for s in shifts:
                    b = plain.copy()
                    suffix = (g.number + s).astype(np.int32).astype("<i4").view(np.uint8).reshape(-1, 4)
                    for k in range(4):
                        b[first + g.length + k] = suffix[:, k]
                    copies.append(b)
                row = np.tile(g.row, len(copies))
                order = np.argsort(row, kind="stable")
                start = np.concatenate([first + k * len(plain) for k in range(len(copies))]) if copies else first
                g = Grams(np.concatenate(copies), start[order], np.tile(g.length + 4, len(copies))[order], row[order], np.tile(g.number, len(copies))[order])
            out.append(g)
        return out

    # ---- n-grams to vectors

    @staticmethod
    def _sum(row: np.ndarray, dim: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds up what is sorted by row and dim."""
        if not len(row):
            return row, dim, val.astype(np.float32)
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (dim[1:] != dim[:-1])]))
        return row[first], dim[first], np.add.reduceat(val.astype(np.float64), first).astype(np.float32)

    def counts(self, parts: list[Grams]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c, sums = self.c, []
        for g in parts:
            h = hash_slices(g.buffer, g.start, g.length, c.hash_algorithm)
            dim = h & self.mask
            if not c.vect_sign and c.hash_bits + len(g.row).bit_length() <= 64:
                sums.append(self._counted(g.row, dim))
                continue
            val = np.ones(len(h), np.float32)
            if c.vect_sign:
                val[(h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) > 0] = -1
            order = np.lexsort((dim, g.row))
            # g.row is in order already, so `order` moves entries within their row only
            sums.append(self._sum(g.row[order], dim[order], val if c.sign_mode == "reference" else val[order]))
        return self.added(sums)

    def _counted(self, row: np.ndarray, dim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What _sum gives of ones, from rows in order: row (its number among those that occur) and dim are sorted as one number."""
        if not len(row):
            return row, dim, np.zeros(0, np.float32)
        new = np.diff(row, prepend=-1) != 0
        bits, rows = np.uint64(self.c.hash_bits), row[new]
        key = np.sort((np.cumsum(new) - 1).astype(np.uint64) << bits | dim) if len(rows) > 1 else np.sort(dim)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[first], np.diff(first, append=len(key)).astype(np.float32)
        return (rows[(key >> bits).astype(np.int64)] if len(rows) > 1 else np.full(len(key), row[0])), key & self.mask, n

    def added(self, several: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sum of several (row, dim, value), each by row and dim."""
        if len(several) == 1:
            return several[0]
        row, dim, val = (np.concatenate(x) for x in zip(*several))
        order = np.lexsort((dim, row))
        return self._sum(row[order], dim[order], val[order])

    @staticmethod
    def _per_row(row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, x, minlength=n)

    def scale(self, row: np.ndarray, dim: np.ndarray, val: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding, norm and thresholds."""
        c = self.c
        with np.errstate(divide="ignore", invalid="ignore"):
            if c.vect_embed == "bin":
                val = np.ones_like(val)
            elif c.vect_embed == "tfidf":
                val = (val.astype(np.float64) / self._per_row(row, val.astype(np.float64), n)[row]).astype(np.float32)
                known, weight = self.idf
                at = np.minimum(np.searchsorted(known, dim), max(0, len(known) - 1))
                there = known[at] == dim if len(known) else np.zeros(len(dim), bool)
                row, dim, val = row[there], dim[there], (val[there].astype(np.float64) * weight[at[there]]).astype(np.float32)
            if c.vect_norm == "l1":
                val = (val / self._per_row(row, np.abs(val.astype(np.float64)), n)[row]).astype(np.float32)
            elif c.vect_norm == "l2":
                val = (val / np.sqrt(self._per_row(row, val.astype(np.float64) ** 2, n))[row]).astype(np.float32)
        keep = np.isfinite(val) & (np.abs(val) > _ZERO)
        if c.thres_low:
            keep &= ~(val.astype(np.float64) < c.thres_low)
        if c.thres_high:
            keep &= ~(val.astype(np.float64) > c.thres_high)
        return row[keep], dim[keep], val[keep]

    def reduced(self, row: np.ndarray, dim: np.ndarray, val: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = self.c
        if c.dim_reduce == "none":
            return row, dim, val
        if c.dim_reduce == "simhash":
            num = min(c.dim_num, c.hash_bits)
            bits = np.stack([self._per_row(row, np.where((dim >> np.uint64(j)) & np.uint64(1), val, -val), n) > 0 for j in range(num)], axis=1)
        elif c.dim_reduce == "minhash":
            rounds = -(-c.dim_num // c.hash_bits)
            bits = np.zeros((n, c.dim_num), bool)
            for r, constant in enumerate(rehash_constants(rounds)[:rounds]):
                low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(low, row, (dim ^ np.uint64(constant)) & self.mask)
                for j in range(min(c.hash_bits, c.dim_num - r * c.hash_bits)):
                    bits[:, r * c.hash_bits + j] = (low >> np.uint64(j)) & np.uint64(1)
        else:
            bits = np.zeros((n, c.dim_num), bool)
            for constant in rehash_constants(c.bloom_num)[: c.bloom_num]:
                bits[row, ((dim ^ np.uint64(constant)) % np.uint64(c.dim_num)).astype(np.int64)] = True
        r, d = np.nonzero(bits)
        return r, d.astype(np.uint64), np.ones(len(r), np.float32)

    def entries(self, data: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, dims and values of the vectors, by row and dim."""
        row, dim, val = self.counts(self.parts(self.preprocess(data)))
        return (row, dim, val) if self.counts_only else self.reduced(*self.scale(row, dim, val, len(data)), len(data))

    def vectors(self, data: list[bytes | None]) -> pa.Array:
        """The vector of each row."""
        return pack_vectors(*self.entries(data), len(data))

    def named(self, data: list[bytes | None]) -> list[tuple[int, int, bytes]]:
        """(row, dim, n-gram) in the order of extraction, with repeats."""
        out = []
        for g in self.parts(self.preprocess(data)):
            dim = (hash_slices(g.buffer, g.start, g.length, self.c.hash_algorithm) & self.mask).view(np.int64)
            out += zip(g.row.tolist(), dim.tolist(), g.strings())
        return out


def pack_vectors(row: np.ndarray, dim: np.ndarray, val: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64))]).astype(np.int32)
    cells = pa.StructArray.from_arrays([pa.array(dim.astype(np.uint64).view(np.int64)), pa.array(val.astype(np.float32))], names=["dim", "val"])
    return pa.ListArray.from_arrays(pa.array(ends), cells).cast(VECTOR_TYPE)


def _places(ids: np.ndarray, known: np.ndarray, at: np.ndarray) -> pa.Array:
    """decimal(38, 0): id * 2^40 + at, in the order of id and at; a null id comes last."""
    cells = np.empty((len(ids), 2), np.int64)
    cells[:, 0] = np.where(known, ids << 40, 0) | at
    cells[:, 1] = np.where(known, ids >> 24, 1 << 40)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(ids), [None, pa.py_buffer(cells.tobytes())])


def distinct_grams(kernel: Kernel, ids: pa.Array, data: pa.Array, chunk_size: int = 0) -> pa.RecordBatch:
    """(chunk, dim, feat, first, n): the distinct n-grams of the rows (of each chunk of ids, with a
    chunk_size), the first one's place and their number."""
    known = np.asarray(pc.is_valid(ids))
    ids = pc.fill_null(ids, 0).to_numpy()
    seen, codes, places = np.zeros(len(ids), np.int64), [], []
    feats, dims = [], []
    for g in kernel.parts(kernel.preprocess(data.to_pylist())):
        raw, first = _gather(g.buffer, g.start, g.length)
        ends = pa.py_buffer(np.append(first, len(raw)).astype(np.int64))
        feats.append(pa.Array.from_buffers(pa.large_binary(), len(first), [None, ends, pa.py_buffer(raw)]))
        dims.append((hash_slices(g.buffer, g.start, g.length, kernel.c.hash_algorithm) & kernel.mask).view(np.int64))
        count = np.bincount(g.row, minlength=len(ids)) if len(g.row) else np.zeros(len(ids), np.int64)
        places.append((g.row, np.arange(len(g.row)) - (np.cumsum(count) - count)[g.row] + seen[g.row]))
        seen += count
    coded = pa.concat_arrays(feats).dictionary_encode()
    row, at = (np.concatenate(x).astype(np.int64) for x in zip(*places))
    code, dim = coded.indices.to_numpy(), np.concatenate(dims)
    chunk, valid, key, kinds = ids // (chunk_size or 1), known[row], code, len(coded.dictionary)
    if chunk_size:  # rows without an id have a chunk of their own
        known_chunks, of_row = np.unique(chunk[known], return_inverse=True)
        group = np.full(len(ids), len(known_chunks))
        group[known] = of_row
        key, kinds = np.unique(group[row] * kinds + code, return_inverse=True)[::-1]
        kinds = len(kinds)
    best, order = np.empty(kinds, np.int64), np.arange(len(code))
    if len(places) > 1 or not known.all() or not (ids[1:] > ids[:-1]).all():
        order = np.lexsort((at, ids[row], ~valid))
    best[key[order[::-1]]] = order[::-1]  # of several, the last one written stays, which is the first in order
    return pa.RecordBatch.from_arrays(
        [
            pa.array(chunk[row[best]], mask=~valid[best] | (chunk_size == 0)),
            pa.array(dim[best]),
            coded.dictionary.take(pa.array(code[best])).cast(pa.binary()),
            _places(ids[row[best]], valid[best], at[best]),
            pa.array(np.bincount(key, minlength=kinds)),
        ],
        names=["chunk", "dim", "feat", "first", "n"],
    )
