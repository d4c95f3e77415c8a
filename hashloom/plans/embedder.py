"""Embedding a table of strings by a configuration."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import ngrams as G
from ..functions import preprocess as P
from ..functions import vectors as V
from ..functions.hashing import feature_hash, let, mask_of
from ..operators import blocks as B
from ..operators import longform as L
from ..operators.kernel import Kernel, distinct_grams, slices
from ..session import ship_package, written

#: IDF weights are broadcast up to this size; beyond it they are joined.
BROADCAST_BYTES = 64 << 20
#: Joined weights are split into buckets of about this size at most.
BUCKET_BYTES = 1 << 20
ENGINES = ("arrow", "catalyst")


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


class Embedder:
    """Turns a binary or string column into vectors.

    `engine` is how: "arrow" runs one vectorised pass over Arrow batches, "catalyst"
    builds expressions only.  Both are row-local, so they serve batch and streams alike;
    only fitting IDF weights shuffles, on dims.
    """

    def __init__(self, config: Config = Config(), engine: str = "arrow", stop_tokens: list[bytes] | None = None, idf: DataFrame | None = None):
        if engine not in ENGINES:
            raise ValueError(f"engine must be one of {', '.join(ENGINES)}")
        self.config, self.engine, self.idf = config, engine, idf
        if stop_tokens is None and config.stoptoken_file:
            stop_tokens = Path(config.stoptoken_file).read_bytes().split(b"\n")
        self.stop_lines = stop_tokens or []

    # ---- fitting

    def fit(self, df: DataFrame, column: str = "data") -> Embedder:
        """An embedder with IDF weights over all of df.  N is df's number of rows.  With
        strict_compat the weights are counted without preprocessing."""
        counts = Config.replace(self.config, vect_embed="bin", vect_norm="none", thres_low=0.0, thres_high=0.0, dim_reduce="none", vect_sign=self.config.vect_sign)
        if self.config.strict_compat:
            counts = counts.replace(decode_str=False, reverse_str=False, stoptoken_file="")
        stop = [] if self.config.strict_compat else self.stop_lines
        n = df.count()
        plain = Embedder(counts, self.engine, stop)
        if self.engine == "arrow":
            ship_package(df.sparkSession)
            frequencies = df.select(F.col(column).cast("binary")).mapInArrow(B.frequencies(plain._kernel()), "dim bigint, df bigint")
            found = frequencies.groupBy("dim").agg(F.sum("df").alias("df"))
        else:
            found = L.document_frequency(L.explode_vectors(plain.transform(df.select(column), column), keys=[]))
        # Written once: counting, collecting and joining them don't embed all rows again.
        return Embedder(self.config, self.engine, self.stop_lines, written(L.weights_of(found, n), "idf"))

    # ---- transforming

    def transform(self, df: DataFrame, column: str = "data", out: str = "vec", keep: list[str] | None = None) -> DataFrame:
        """df's columns (those in `keep`; all but `column` by default) and the vector.  A
        null string is embedded as the empty one."""
        keep = [c for c in df.columns if c != column] if keep is None else keep
        c = self.config
        if c.vect_embed != "tfidf":
            return self._local(df, column, out, keep)
        if self.idf is None:
            raise ValueError("tfidf needs weights: call fit, or give idf")
        rows = self.idf.count()
        if self.engine == "arrow" and rows * 12 <= BROADCAST_BYTES:
            w = self.idf.select("dim", "idf").toArrow()
            dim, weight = (w.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in (0, 1))
            order = np.argsort(dim.view(np.uint64))
            return self._arrow(df, column, out, keep, idf=(dim.view(np.uint64)[order], weight[order].astype(np.float32)))
        return self._joined_tfidf(df, column, out, keep)

    def transform_all(self, df: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
        """df's columns in `keep` and a vector for each of several columns, in one pass (not for tfidf)."""
        if self.config.vect_embed == "tfidf":
            raise ValueError("tfidf needs the weights of one column")
        if self.engine == "arrow":
            return self._arrow_all(df, columns, keep)
        return df.select(*keep, *[self.vector(F.col(c)).alias(out) for c, out in columns.items()])

    def entries(self, df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
        """A row (keep..., dim, val) for each entry of the sum of the columns' vectors (not for tfidf): what
        explode_vectors gives, but Arrow batches hold the rows at once, and no vector is packed and unpacked."""
        if self.config.vect_embed == "tfidf":
            raise ValueError("tfidf needs the weights of one column")
        if self.engine != "arrow":
            vecs = [self.vector(F.col(c)) for c in columns]
            return L.explode_vectors(df.select(*keep, reduce(V.add, vecs).alias("vec")), keys=keep)
        ship_package(df.sparkSession)
        kernel, names, data = self._kernel(), [f"__k{n}" for n in range(len(keep))], range(len(columns))
        picked = df.select(*[F.col(c).cast("binary").alias(f"__v{n}") for n, c in enumerate(columns)], *[F.col(k).alias(n) for k, n in zip(keep, names)])

        def run(batches):
            for b in slices(batches):
                row, dim, val = kernel.added([kernel.entries(b.column(n).to_pylist()) for n in data])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[k.take(at) for k in b.columns[len(data) :]], pa.array(dim.view(np.int64)), pa.array(val)], names=[*names, "dim", "val"])

        kept = "".join(f"`{n}` {picked.schema[n].dataType.simpleString()}, " for n in names)
        done = picked.mapInArrow(run, f"{kept}dim bigint, val float")
        return done.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], "dim", "val")

    def total(self, df: DataFrame, column: str = "data") -> DataFrame:
        """(dim, val): the sum of the rows' vectors (not for tfidf), added up in each task before it moves."""
        if self.engine != "arrow":
            return L.sum_vectors(self.entries(df, [column], []).withColumn("val", F.col("val").cast("double")))
        if self.config.vect_embed == "tfidf":
            raise ValueError("tfidf needs the weights of one column")
        ship_package(df.sparkSession)
        return L.sum_vectors(df.select(F.col(column).cast("binary")).mapInArrow(B.sums(self._kernel()), "dim bigint, val double"))

    def _joined_tfidf(self, df: DataFrame, column: str, out: str, keep: list[str]) -> DataFrame:
        """TF-IDF by a join on dim, for weights that are too many to broadcast.

        What moves are not entries but blocks: the entries that a slice of rows has in one of
        the buckets of dims.  A bucket's blocks meet its weights, and those of a slice its rows.
        The blocks are written once, so that a slice's tag stays the same when a task is repeated."""
        ship_package(df.sparkSession)
        plain = Embedder(self.config.replace(vect_embed="cnt", vect_norm="none", thres_low=0.0, thres_high=0.0, dim_reduce="none"), self.engine, self.stop_lines)
        names = [f"__k{n}" for n in range(len(keep))]
        arrow = self.engine == "arrow"
        data = F.col(column).cast("binary") if arrow else plain.vector(F.col(column))
        picked = df.select(data.alias("__data"), *[F.col(k).alias(n) for k, n in zip(keep, names)])
        spark = df.sparkSession
        least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.idf.count() * 12 // BUCKET_BYTES)
        buckets, entries = 1 << (least - 1).bit_length(), B.entries(plain._kernel() if arrow else None)
        kinds = [(n, picked.schema[n].dataType.simpleString()) for n in names]
        kept = "".join(f", `{n}` {t}" for n, t in kinds)
        blocks = written(picked.mapInArrow(B.blocks(entries, names, buckets), f"{B.BLOCK}{kept}"), "tfidf")
        weights = self.idf.withColumn("bucket", F.col("dim").bitwiseAND(F.lit(buckets - 1)).cast("int")).groupBy("bucket")
        weights = weights.agg(F.sort_array(F.collect_list(F.struct("dim", "idf"))).alias("weights"))
        of_bucket = blocks.filter("bucket >= 0").select("bucket", "tag", "cells").unionByName(weights, allowMissingColumns=True)
        weighted = of_bucket.repartition("bucket").sortWithinPartitions("bucket", F.col("tag").asc_nulls_first()).mapInArrow(B.weighted, "tag bigint, cells binary")
        of_slice = blocks.filter("bucket < 0").select("tag", "at", *names).unionByName(weighted, allowMissingColumns=True)
        after = Kernel(self.config.replace(vect_embed="cnt"))
        done = of_slice.repartition("tag").sortWithinPartitions("tag", F.col("at").asc_nulls_last()).mapInArrow(B.joined(names, after), f"`__vec` {V.VECTOR}{kept}")
        return done.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], F.col("__vec").alias(out))

    def _local(self, df: DataFrame, column: str, out: str, keep: list[str]) -> DataFrame:
        if self.engine == "arrow":
            return self._arrow(df, column, out, keep)
        return df.select(*keep, self.vector(F.col(column)).alias(out))

    def _kernel(self, idf=None, **how) -> Kernel:
        c = self.config
        return Kernel(c, P.stop_hashes(self.stop_lines, c.hash_algorithm, c.strict_compat), idf, **how)

    def _arrow(self, df: DataFrame, column: str, out: str, keep: list[str], idf=None) -> DataFrame:
        return self._arrow_all(df, {column: out}, keep, idf)

    def _arrow_all(self, df: DataFrame, columns: dict[str, str], keep: list[str], idf=None) -> DataFrame:
        ship_package(df.sparkSession)
        kernel = self._kernel(idf)
        names, vecs = [f"__k{n}" for n in range(len(keep))], [f"__v{n}" for n in range(len(columns))]
        picked = df.select(*[F.col(c).cast("binary").alias(v) for c, v in zip(columns, vecs)], *[F.col(k).alias(n) for k, n in zip(keep, names)])

        def run(batches):
            for b in slices(batches):
                made = [kernel.vectors(b.column(n).to_pylist()) for n in range(len(vecs))]
                yield pa.RecordBatch.from_arrays([*made, *b.columns[len(vecs) :]], names=[*vecs, *names])

        fields = [f"`{v}` {V.VECTOR}" for v in vecs] + [f"`{n}` {picked.schema[n].dataType.simpleString()}" for n in names]
        done = picked.mapInArrow(run, ", ".join(fields))
        return done.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], *[F.col(v).alias(out) for v, out in zip(vecs, columns.values())])

    # ---- as expressions

    def preprocessed(self, data: Column) -> Column:
        c = self.config
        data = F.coalesce(data.cast("binary"), F.lit(b""))
        if c.decode_str:
            data = P.uri_decode(data)
        if c.reverse_str:
            data = P.reverse_bytes(data)
        if self.stop_lines:
            if any(not _is_utf8(s) for s in self.stop_lines):
                raise ValueError("the catalyst engine works on text: stop tokens must be UTF-8 (the arrow engine takes any bytes)")
            stop = [P.decode_bytes(s.rstrip(b"\r\n")).decode("utf-8") for s in self.stop_lines if s.strip(b"\r\n")]
            data = P.stop_filter(data, stop, c.delims)
        return data

    def grams(self, data: Column) -> list[Column]:
        c = self.config
        return G.ngram_parts(self.preprocessed(data), c.granularity, c.ngram_len, c.delims, c.ngram_sort, c.ngram_pos, c.pos_shift, c.ngram_blend)

    def counts(self, data: Column) -> Column:
        c, vec = self.config, None
        for grams in self.grams(data):
            hashes = F.transform(grams, lambda g: feature_hash(g, c.hash_algorithm))

            def dims(h: Column) -> Column:
                return F.transform(h, lambda x: x.bitwiseAND(F.lit(mask_of(c.hash_bits))))

            def signs(h: Column) -> Column:
                low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
                return F.transform(h, lambda x: F.when((low(x) > 0) & (low(x) < (1 << 31)), F.lit(-1.0)).otherwise(F.lit(1.0)))

            part = let(hashes, lambda h: V.vector_of(dims(h), signs(h) if c.vect_sign else None, c.sign_mode if c.vect_sign else "aligned"))
            vec = part if vec is None else V.add(vec, part)
        return vec

    def _after(self, vec: Column) -> Column:
        c = self.config
        vec = V.sparsify(V.threshold(V.norm(vec, c.vect_norm), c.thres_low, c.thres_high))
        return V.reduce_dims(vec, c.dim_reduce, c.hash_bits, c.dim_num, c.bloom_num)

    def vector(self, data: Column) -> Column:
        """The vector of a string column, as one expression (not for tfidf)."""
        return self._after(V.embed(self.counts(data), self.config.vect_embed))

    # ---- dictionary

    def named(self, df: DataFrame, row_id: str = "row_id", column: str = "data") -> DataFrame:
        """(row_id, part, at, dim, feat): each n-gram of each row, in the order of extraction."""
        ship_package(df.sparkSession)
        kernel = self._kernel()

        def run(batches):
            for b in slices(batches):
                ids = b.column(0).to_pylist()
                out, at = [], 0
                for row, dim, feat in kernel.named(b.column(1).to_pylist()):
                    out.append((ids[row], at, dim, feat))
                    at += 1
                cols = list(zip(*out)) if out else [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([arrays[0], pa.array(np.zeros(len(out), np.int32)), *arrays[1:]], names=["row_id", "part", "at", "dim", "feat"])

        picked = df.select(F.col(row_id).cast("bigint"), F.col(column).cast("binary"))
        return picked.mapInArrow(run, "row_id bigint, part int, at bigint, dim bigint, feat binary")

    def dictionary(self, df: DataFrame, row_id: str = "row_id", column: str = "data", chunked: bool = False) -> DataFrame:
        """The feature dictionary of df; `chunked` keeps one for each chunk_size rows.

        Each slice gives a row for each of its distinct n-grams, with the first place and the count."""
        ship_package(df.sparkSession)
        kernel, chunk_size = self._kernel(), self.config.chunk_size if chunked else 0

        def run(batches):
            for b in slices(batches):
                yield distinct_grams(kernel, b.column(0), b.column(1), chunk_size)

        picked = df.select(F.col(row_id).cast("bigint"), F.col(column).cast("binary"))
        first = picked.mapInArrow(run, "chunk bigint, dim bigint, feat binary, first decimal(38,0), n bigint")
        return L.dictionary_of_firsts(first if chunked else first.drop("chunk"), ["chunk"] if chunked else None)
