"""Sinks for (row_id, src, label, vec) and, with a dictionary, the n-grams of its dims.

Text formats are made on the executors and written as a folder of parts; `single_file`
writes one local file instead, in the order of row_id.
"""

from __future__ import annotations

import json
import logging
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..config import Config
from ..functions import vectors as V
from ..operators.kernel import slices
from ..session import ship_package
from . import formats as T
from . import matfile

log = logging.getLogger("hashloom")
FEATS = "map<bigint,binary>"


def skip_null(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Without the rows whose vector has no entries."""
    return df.filter(F.size(vec) > 0)


def with_features(df: DataFrame, dictionary: DataFrame, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """df with `feats`, a map from the dims of its vector to their n-grams in the dictionary (dim,
    feat; with a chunk column also joined on chunk).  The entries go through a join on dim."""
    on = [c for c in ("chunk", "dim") if c in dictionary.columns]
    if "chunk" in on and "chunk" not in df.columns:
        raise ValueError("a dictionary by chunk needs a chunk column")
    extra = [c for c in ("chunk",) if c in on]
    entries = df.select(*keys, *extra, F.explode("vec").alias("e")).select(*keys, *extra, F.col("e.dim").alias("dim"))
    found = entries.join(dictionary.select(*on, "feat"), on)
    packed = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("dim", "feat"))).alias("feats"))
    return df.join(packed, list(keys), "left").withColumn("feats", F.coalesce("feats", F.map_from_arrays(F.array(), F.array()).cast(FEATS)))


def _with_features(src: list, vec: list, feats: list, kind: str) -> list[str]:
    one = T.json_record if kind == "json" else T.text_line
    return [one(T.pairs(v), s, dict(f) if f is not None else {}) for s, v, f in zip(src, vec, feats)]


def _lines(src: pa.Array, label: pa.Array, vec: pa.Array, kind: str) -> pa.Array:
    """The lines of a batch; each cell is made by Arrow's kernels, and %g runs once for each distinct value."""
    cells, size = vec.flatten(), pc.fill_null(pc.list_value_length(vec), 0).to_numpy().astype(np.int64)
    dims = pa.array(cells.field(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(1)).cast(pa.string())
    known, which = np.unique(cells.field(1).to_numpy(zero_copy_only=False).view(np.int32), return_inverse=True)  # by their bits: nan and -0 stay apart
    vals = pa.array([T.g6(float(v)) for v in known.view(np.float32)], pa.string()).take(pa.array(which.reshape(-1)))
    ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))

    def joined(parts: pa.Array, by: str) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(ends, parts), by)

    def cell(between: str) -> pa.Array:
        return pc.binary_join_element_wise(dims, vals, between)

    said = pc.fill_null(src, "")
    named = pc.not_equal(said, "")
    if kind == "json":
        shown = pa.array([json.dumps(s) for s in said.to_pylist()], pa.string())
        return pc.binary_join_element_wise('{"dim":[', joined(dims, ","), '],"val":[', joined(vals, ","), '],"src":', shown, "}", "")
    if kind == "cluto":
        return joined(cell(" "), " ")
    if kind == "libsvm":
        marks = pa.array([T.g6(x or 0.0) for x in label.to_pylist()], pa.string())
        full = pa.array(np.where(size > 0, " ", ""))
        return pc.binary_join_element_wise(marks, " ", joined(cell(":"), " "), full, pc.if_else(named, pc.binary_join_element_wise("# ", said, ""), ""), "")
    return pc.binary_join_element_wise(joined(cell("::"), ","), pc.if_else(named, pc.binary_join_element_wise(" # ", said, ""), ""), "")


def _batches_of_lines(batches, kind: str, with_feats: bool = False):
    for b in slices(batches):
        if with_feats:
            value = pa.array(_with_features(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), kind), pa.string())
        else:
            value = _lines(b.column(1), b.column(2), b.column(3), kind).cast(pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), value], names=["row_id", "value"])


def formatted(df: DataFrame, kind: str) -> DataFrame:
    """(row_id, value): each row as a line of the format."""
    ship_package(df.sparkSession)
    with_feats = "feats" in df.columns and kind not in ("libsvm", "cluto")
    picked = [F.col("row_id").cast("bigint"), F.col("src").cast("string").alias("src"), F.col("label").cast("float").alias("label"), F.col("vec").cast(V.VECTOR).alias("vec")]

    def run(batches):
        return _batches_of_lines(batches, kind, with_feats)

    return df.select(*picked, *(["feats"] if with_feats else [])).mapInArrow(run, "row_id bigint, value string")


def cluto_header(df: DataFrame, bits: int) -> DataFrame:
    """One row (value): the numbers of rows, columns and entries, each 12 wide."""
    made = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("nnz"))
    return made.select(F.concat_ws(" ", *[F.lpad(c.cast("string"), 12, " ") for c in (F.col("n"), F.lit(1 << bits), F.col("nnz"))]).alias("value"))


def _in_order(lines: DataFrame) -> Iterator[str]:
    return (r.value for r in lines.orderBy("row_id").toLocalIterator(prefetchPartitions=True))


def _header(kind: str) -> str:
    return f"# hashloom {__version__} - {kind} vectors\n"


def _write_text(kind: str):
    def write(df: DataFrame, path: str, config: Config, single_file: bool) -> None:
        lines = formatted(df, kind)
        if not single_file:
            if kind == "cluto":
                cluto_header(df, config.hash_bits).coalesce(1).write.text(f"{path}/header")
                lines.select("value").write.text(f"{path}/rows")
            else:
                lines.select("value").write.text(path)
            return
        with open(path, "w", encoding="utf-8", errors="surrogateescape") as f:
            if kind == "text":
                f.write(_header(kind))
            if kind == "cluto":
                f.write(cluto_header(df, config.hash_bits).first().value + "\n")
            if kind == "json":
                f.write("[")
            for n, line in enumerate(_in_order(lines)):
                f.write((",\n" if n else "\n") + line if kind == "json" else line + "\n")
            if kind == "json":
                f.write("\n]\n")

    return write


def _write_stdout(df: DataFrame, path: str, config: Config, single_file: bool, out=None) -> None:
    out = out or sys.stdout
    out.write(_header("text"))
    for line in _in_order(formatted(df, "text")):
        out.write(line + "\n")


def _write_matlab(df: DataFrame, path: str, config: Config, single_file: bool) -> None:
    if config.hash_bits > 31:
        raise ValueError("a MAT-file holds at most 31 bits of dimensions")
    with_feats = "feats" in df.columns

    def records():
        for r in df.orderBy("row_id").toLocalIterator(prefetchPartitions=True):
            cells = T.pairs(r["vec"])
            feats = r["feats"] or {} if with_feats else {}
            yield [d for d, _ in cells], [v for _, v in cells], r["src"] or "", float(r["label"] or 0), [bytes(feats.get(d, b"")).decode("latin-1") for d, _ in cells]

    matfile.write_mat(path, records(), config.hash_bits, with_feats)


SINKS: dict[str, Callable] = {
    "libsvm": _write_text("libsvm"),
    "text": _write_text("text"),
    "list": _write_text("text"),
    "stdout": _write_stdout,
    "json": _write_text("json"),
    "cluto": _write_text("cluto"),
    "matlab": _write_matlab,
    "parquet": lambda df, path, config, single_file: df.write.parquet(path),
}


def write_vectors(df: DataFrame, path: str, config: Config = Config(), single_file: bool = False) -> None:
    """Writes by the configuration's output_format; "-" is the standard output, an unknown name
    is written as text.  matlab always writes one local file."""
    kind = "stdout" if path == "-" else config.output_format.lower()
    if kind not in SINKS:
        log.error("unknown output format %r, writing text", kind)
        kind = "text"
    SINKS[kind](skip_null(df) if config.skip_null else df, path, config, single_file)
