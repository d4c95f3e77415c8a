"""Vectors as rows (key..., dim, val): what joins and aggregates over whole tables need.

Counting happens before anything moves (a packed vector holds each dim once), so the
shuffles below carry one row for a document and dim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def explode_vectors(df: DataFrame, vec: str = "vec", keys: list[str] | None = None) -> DataFrame:
    """A row for each entry; vectors without entries give none."""
    keys = [c for c in df.columns if c != vec] if keys is None else keys
    # explode() would have the optimizer filter by the vector's size, where it works the vector out a second time
    return df.select(*keys, F.explode_outer(vec).alias("__e")).filter(F.col("__e").isNotNull()).select(*keys, F.col("__e.dim").alias("dim"), F.col("__e.val").alias("val"))


def implode_vectors(long: DataFrame, keys: list[str], spine: DataFrame | None = None, vec: str = "vec") -> DataFrame:
    """Back to a vector for each key, sorted by dim.  With `spine` (a table of the keys)
    the keys without entries get the empty vector."""
    packed = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", F.col("val").cast("float").alias("val")))).alias(vec))
    if spine is None:
        return packed
    return spine.join(packed, keys, "left").withColumn(vec, F.coalesce(vec, V.empty_vector()))


def document_frequency(long: DataFrame) -> DataFrame:
    """(dim, df): in how many vectors each dim has an entry."""
    return long.groupBy("dim").agg(F.count("*").alias("df"))


def idf_weights(long: DataFrame, n_documents: int | Column) -> DataFrame:
    """(dim, idf): log2(N / df), rounded to a float after each step."""
    return weights_of(document_frequency(long), n_documents)


def weights_of(found: DataFrame, n_documents: int | Column) -> DataFrame:
    """The same from the document frequencies (dim, df)."""
    n = n_documents if isinstance(n_documents, Column) else F.lit(n_documents)
    rate = (F.lit(1.0) / F.col("df").cast("float")).cast("float")
    return found.select("dim", F.log2((rate * n.cast("float")).cast("float").cast("double")).cast("float").alias("idf"))


def apply_idf(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """Values times their dim's weight; dims without a weight go."""
    return tf.join(idf, "dim").withColumn("val", (F.col("val").cast("double") * F.col("idf").cast("double")).cast("float")).drop("idf")


def sum_vectors(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The sum of the vectors of each key (of all, without keys)."""
    return long.groupBy(*(keys or []), "dim").agg(F.sum("val").cast("float").alias("val"))


def product_join(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Entry-wise products on the dims (and keys) that both have."""
    on = [*(keys or []), "dim"]
    right = b.select(*on, F.col("val").alias("__val"))
    return a.join(right, on).withColumn("val", (F.col("val").cast("double") * F.col("__val").cast("double")).cast("float")).drop("__val")


def dot_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """(a_key, b_key, dot) of all pairs that share a dim: a join on dim and a sum."""
    right = b.select(F.col(b_key), "dim", F.col("val").alias("__val"))
    term = (F.col("val") * F.col("__val")).cast("float").cast("double")
    return a.select(a_key, "dim", "val").join(right, "dim").groupBy(a_key, b_key).agg(F.sum(term).alias("dot"))


def dictionary(named: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope..., dim, feat, insertions, collisions) from (row_id, part, at, dim, feat).

    The first n-gram of a dim wins, by row_id, part and place; a later one with other bytes
    is a collision.
    """
    place = F.struct("row_id", "part", "at")
    return dictionary_of_firsts(named.select(*(scope or []), "dim", "feat", place.alias("first"), F.lit(1).cast("bigint").alias("n")), scope)


def dictionary_of_firsts(rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The same from rows that stand for n n-grams, of which the first is at the place `first`.  A decimal
    as place is summed up in a hash table, where a struct would have all rows sorted."""
    scope = scope or []
    distinct = rows.groupBy(*scope, "dim", "feat").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    return distinct.groupBy(*scope, "dim").agg(
        F.min_by("feat", "first").alias("feat"),
        F.sum("n").alias("insertions"),
        (F.sum("n") - F.min_by("n", "first")).alias("collisions"),
    )


def collision_stats(entries: DataFrame) -> DataFrame:
    """(size, insertions, collisions, collision_rate) of a dictionary; the rate is in percent."""
    return entries.agg(
        F.count("*").alias("size"),
        F.coalesce(F.sum("insertions"), F.lit(0)).alias("insertions"),
        F.coalesce(F.sum("collisions"), F.lit(0)).alias("collisions"),
    ).withColumn("collision_rate", F.coalesce(F.try_divide(F.col("collisions") * 100.0, F.col("insertions")), F.lit(0.0)))
