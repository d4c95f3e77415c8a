"""Weights for vectors' entries without broadcasting: blocks of entries by bucket of dims.

A block holds, as one binary value, the entries (row of the slice, dim, value) that a slice of
rows has in a bucket.  The functions here are for mapInArrow.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from .kernel import pack_vectors, slices

CELL = np.dtype([("row", "<i4"), ("val", "<f4"), ("dim", "<i8")])
#: Rows with bucket -1 are the slice's own, in the order of `at`; the others are blocks.
BLOCK = "tag bigint, bucket int, at int, cells binary"


def entries(kernel):
    """A function from an array of strings (of vectors, without a kernel) to (row, dim, value)."""

    def of_strings(data: pa.Array):
        return kernel.entries(data.to_pylist())

    def of_vectors(vec: pa.Array):
        cells, size = vec.flatten(), pc.fill_null(pc.list_value_length(vec), 0).to_numpy()
        dim, val = (cells.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        return np.repeat(np.arange(len(vec)), size), dim.view(np.uint64), val

    return of_strings if kernel is not None else of_vectors


def frequencies(kernel):
    """Strings to (dim, df): in how many of a slice's rows each dim has an entry."""

    def run(batches):
        for b in slices(batches):
            dims, df = np.unique(kernel.entries(b.column(0).to_pylist())[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(dims.view(np.int64)), pa.array(df.astype(np.int64))], names=["dim", "df"])

    return run


def _added(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each dim of the pieces once, with the sum of its values, in double."""
    dim, val = (np.concatenate(x) for x in zip(*pieces))
    order = np.argsort(dim)
    dim, val = dim[order], val[order].astype(np.float64)
    first = np.flatnonzero(np.concatenate([[True], dim[1:] != dim[:-1]])) if len(dim) else np.zeros(0, np.int64)
    return dim[first], np.add.reduceat(val, first) if len(dim) else val


def sums(kernel, most: int = 1 << 18):
    """Strings to (dim, val): the sum of the rows' vectors, each task's own before anything moves.  It holds
    `most` entries, or those of one slice, at a time, and passes on what stays more than half of that."""

    def run(batches):
        held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["dim", "val"])

        for b in slices(batches):
            held.append(_added([kernel.entries(b.column(0).to_pylist())[1:]]))
            size += len(held[-1][0])
            if size > most:
                held = [_added(held)]
                size = len(held[0][0])
                if size > most // 2:
                    yield out()
                    held, size = [], 0
        if size:
            held = [_added(held)]
            yield out()

    return run


def blocks(entries, names: list[str], buckets: int):
    """(__data, names...) to the rows of each slice, under a tag that no other has, and its blocks
    of term frequencies."""

    def run(batches):
        tags = itertools.count(TaskContext.get().taskAttemptId() << 28)
        for b, tag in zip(slices(batches), tags):
            n = b.num_rows
            row, dim, val = entries(b.column(0))
            with np.errstate(divide="ignore", invalid="ignore"):
                val = (val.astype(np.float64) / np.bincount(row, val.astype(np.float64), minlength=n)[row]).astype(np.float32)
            there = np.isfinite(val) & (val != 0)
            cells = np.empty(int(there.sum()), CELL)
            cells["row"], cells["val"], cells["dim"] = row[there], val[there], dim[there].view(np.int64)
            bucket = (cells["dim"] & (buckets - 1)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            known, first = np.unique(bucket[order], return_index=True)
            raw, ends = cells[order].tobytes(), np.append(first, len(order)) * CELL.itemsize
            packed = pa.array([raw[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
            kept = b.columns[1:]
            for own in (True, False):
                m = n if own else len(known)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, tag, np.int64)),
                        pa.array(np.full(m, -1, np.int32) if own else known),
                        pa.array(np.arange(m, dtype=np.int32)) if own else pa.nulls(m, pa.int32()),
                        pa.nulls(m, pa.binary()) if own else packed,
                        *(kept if own else [pa.nulls(m, k.type) for k in kept]),
                    ],
                    names=["tag", "bucket", "at", "cells", *names],
                )

    return run


def weighted(batches):
    """(bucket, tag, cells, weights) by bucket, the weights first, to (tag, cells) with the values
    times their dim's weight; dims without a weight go."""
    bucket, known, weight = None, np.zeros(0, np.int64), np.zeros(0)
    for b in slices(batches):
        tags, out = [], []
        for i in range(b.num_rows):
            if b.column(0)[i].as_py() != bucket:
                bucket, known, weight = b.column(0)[i].as_py(), np.zeros(0, np.int64), np.zeros(0)
            if b.column(1)[i].as_py() is None:
                w = b.column(3)[i].values
                known, weight = (w.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                weight = weight.astype(np.float64)
                continue
            if not len(known):
                continue
            cells = np.frombuffer(b.column(2)[i].as_buffer(), CELL)
            at = np.minimum(np.searchsorted(known, cells["dim"]), len(known) - 1)
            there = known[at] == cells["dim"]
            done = cells[there]
            done["val"] = (done["val"].astype(np.float64) * weight[at[there]]).astype(np.float32)
            tags.append(b.column(1)[i].as_py())
            out.append(done.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array(out, pa.binary())], names=["tag", "cells"])


def joined(names: list[str], after):
    """(tag, at, names..., cells) by tag, a slice's own rows first, to (__vec, names...), the vectors
    scaled and reduced by the kernel `after`."""

    def whole(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        n = len(t) - t.column("at").null_count
        raw = b"".join(t.column("cells").slice(n).to_pylist())
        cells = np.frombuffer(raw, CELL)
        cells = cells[np.lexsort((cells["dim"], cells["row"]))]
        row, dim, val = (np.ascontiguousarray(cells[k]) for k in ("row", "dim", "val"))
        vec = pack_vectors(*after.reduced(*after.scale(row.astype(np.int64), dim.view(np.uint64), val, n), n), n)
        own = t.slice(0, n).combine_chunks()
        return pa.RecordBatch.from_arrays([vec, *[pa.concat_arrays(own.column(k).chunks) if n else pa.nulls(0, own.column(k).type) for k in names]], names=["__vec", *names])

    def run(batches):
        parts: list[pa.RecordBatch] = []
        for b in batches:
            tags = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(tags[1:] != tags[:-1]) + 1).tolist(), len(tags)]
            for s, e in zip(edges[:-1], edges[1:]):
                if parts and s < e and parts[0].column(0)[0].as_py() != tags[s]:
                    yield whole(parts)
                    parts = []
                if s < e:
                    parts.append(b.slice(s, e - s))
        if parts:
            yield whole(parts)

    return run
