"""What the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import session
from ..session import drop_table, ship_package

#: A side is broadcast only up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The application's folder; what is written there needs the shuffle files that made it
    no longer, so Spark drops them as soon as their job ends."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return session.shared_dir(spark)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, and
    survives the loss of an executor.  `written_path` is set on the result."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that no later result reads."""
    for t in tables:
        drop_table(t.sparkSession, t.written_path)


def sized_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only if df's counted rows fit in `limit` bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def slices(batches):
    """The rows of the batches in batches of about SLICE_BYTES, or of one longer row."""
    for b in batches:
        rows = max(1, b.num_rows * SLICE_BYTES // max(1, b.nbytes))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with this package's code at hand on the executors, and in batches whose
    working memory stays small where texts are long."""
    ship_package(df.sparkSession)
    return df.mapInArrow(lambda batches: run(slices(batches)), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among ids.doc_id (nulls stay)."""
    gone = ids.select(F.col("doc_id").alias("__gone_id"))
    return docs.join(sized_broadcast(gone, 16), docs["doc_id"] == F.col("__gone_id"), "left_anti")


def sample_texts(
    docs: DataFrame, marks: DataFrame, column: str, classes: list, per_class: int, seed: int, max_bytes: int = 8 << 20
) -> dict:
    """{class: [(doc_id, text), ...]}: the documented bounded training sample.

    Of the marked rows of each class, the `per_class` with the smallest seeded
    hash of doc_id are taken, with their whole texts, as long as a class stays
    under `max_bytes`.  The ids that are collected number per_class x classes,
    whatever the corpus holds.  Ids marked with two classes are left out, and
    so are null ids and blank texts.
    """
    clear = (
        marks.select(F.col("doc_id").alias("doc_id"), F.col(column).alias("mark"))
        .filter(F.col("doc_id").isNotNull() & F.col("mark").isin(classes))
        .groupBy("doc_id")
        .agg(F.min("mark").alias("mark"), F.max("mark").alias("other"))
        .filter("mark = other")
    )
    best = W.partitionBy("mark").orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id")
    chosen = {r.doc_id: r.mark for r in clear.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_class).collect()}
    out: dict = {c: [] for c in classes}
    if not chosen:
        return out
    rows = (
        docs.filter(F.col("doc_id").isin(list(chosen)) & (F.length(F.trim("text")) > 0))
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rank_of = {r: int.from_bytes(hashlib.blake2b(f"{seed}:{r}".encode(), digest_size=8).digest()) for r in chosen}
    used = dict.fromkeys(classes, 0)
    for r in sorted(rows, key=lambda r: (rank_of[r.doc_id], r.doc_id)):
        c = chosen[r.doc_id]
        size = len(r.text.encode("utf-8", "replace"))
        if used[c] + size <= max_bytes:
            used[c] += size
            out[c].append((r.doc_id, r.text))
    return out


def held_out(doc_id: int) -> bool:
    """Three in ten of a training sample's documents, by hash."""
    return hashlib.blake2b(f"held:{doc_id}".encode(), digest_size=2).digest()[0] < 77


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (intercept last) by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + l2 * w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def blocks(data: bytes, size: int) -> list[bytes]:
    """All of data, in pieces of at most `size` bytes."""
    return [data[i : i + size] for i in range(0, len(data), size)]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, split at ASCII white space (empty ones dropped), and the
    offsets at which each text's words begin (one more at the end).  Null texts
    have no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)])
    return (flat if full.all() else flat.filter(pa.array(full))), kept[offsets]


def folded(text: str) -> str:
    """Without regard to case and to compatible forms of characters."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def tokens(texts: list) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, letters, marks and digits in a row, and each text's place among them."""
    plain = pa.array([folded(t) if t else "" for t in texts], pa.large_string())
    return split_words(pc.replace_substring_regex(plain, r"[^\p{L}\p{M}\p{N}]+", " "))
