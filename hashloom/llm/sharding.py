"""Sharding by Karmarkar-Karp differencing.

Documents with the same text are a group that isn't split.  A group starts as a
partial partition: its bytes on one shard, nothing on the others.  The two partial
partitions with the largest spread (largest minus smallest shard) are combined, the
one's largest shard with the other's smallest and so on, until one is left.

That is done in a tree: groups fall into buckets by hash and each bucket's groups
are combined in one task; the buckets' results are partial partitions again and are
combined in the same way, up to `fan_in` of them in a task, until one is left.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import forget, written

SHARDS = 64
FAN_IN = 8192


def difference(partials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines n partial partitions (n x shards) into one.

    Gives (sums, place): place[i, s] is the shard of the result that shard s of
    partial i goes to.  Equal spreads go by row number, equal shards by shard number.
    """
    n, k = partials.shape
    place = np.empty((n, k), np.int32)
    if n == 0:
        return np.zeros(k, np.int64), place
    sums = [None] * (2 * n - 1)
    kids: list = [None] * (2 * n - 1)
    heap = []
    for i in range(n):
        order = np.argsort(-partials[i], kind="stable")
        sums[i] = partials[i][order]
        kids[i] = order  # sorted shard -> own shard
        heap.append((-int(sums[i][0] - sums[i][-1]), i))
    heapq.heapify(heap)
    new = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        sums[new] = total[order]
        kids[new] = (a, b, order)
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(total[order[0]] - total[order[-1]]), new))
        new += 1
    # Walk down: at[x][s] is the final shard of x's sorted shard s.
    at: dict[int, np.ndarray] = {new - 1: np.arange(k, dtype=np.int32)}
    for x in range(new - 1, n - 1, -1):
        a, b, order = kids[x]
        mine = np.empty(k, np.int32)
        mine[order] = at.pop(x)
        at[a], at[b] = mine, mine[::-1]
    for i in range(n):
        place[i, kids[i]] = at[i]
    return sums[new - 1].astype(np.int64), place


def shard(docs: DataFrame, shards: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, bytes, shard) of every row with a doc_id.

    bytes is the UTF-8 length of the text.  Rows with equal texts share a shard;
    null texts weigh nothing and share one, empty ones likewise.  Rows with a null
    doc_id are left out; repeated rows each weigh and are returned.  Of equal groups the
    order is that of their hash.  Other columns are not read; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    sized = written(
        docs.filter("doc_id is not null").select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"),
            F.xxhash64("text").alias("h1"),
            F.xxhash64(F.lit(7), "text").alias("h2"),
        ),
        "sizes",
    )
    groups = sized.groupBy("h1", "h2").agg(F.sum("bytes").alias("weight"))
    n = groups.count()
    buckets = max(1, math.ceil(n / fan_in))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "h1", "h2"], ascending=[False, True, True], ignore_index=True)
        start = np.zeros((len(pdf), shards), np.int64)
        start[:, 0] = pdf["weight"]
        sums, place = difference(start)
        out = pdf[["h1", "h2", "bucket"]].copy()
        out["slot"] = place[:, 0]
        out["sums"] = [sums.tolist() if i == 0 else None for i in range(len(out))]
        return out

    placed = written(
        groups.withColumn("bucket", F.pmod(F.xxhash64("h1", "h2"), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .applyInPandas(first, "h1 bigint, h2 bigint, bucket int, slot int, sums array<bigint>"),
        "placed",
    )
    sums = placed.filter("sums is not null").select("bucket", "sums")
    maps = None  # (bucket, places): how far the shards of each bucket have been carried
    level = buckets
    tables = [sized, placed]
    while level > 1:
        level = math.ceil(level / fan_in)

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bucket", ignore_index=True)
            total, place = difference(np.array(pdf["sums"].tolist(), np.int64).reshape(len(pdf), shards))
            out = pdf[["bucket", "above"]].copy()
            out["places"] = place.tolist()
            out["sums"] = [total.tolist() if i == 0 else None for i in range(len(out))]
            return out

        up = written(
            sums.withColumn("above", F.pmod(F.col("bucket"), F.lit(level)).cast("int"))
            .groupBy("above")
            .applyInPandas(join, "bucket int, above int, places array<int>, sums array<bigint>"),
            "joined",
        )
        tables.append(up)
        step = up.select("bucket", "above", "places")
        if maps is None:
            maps = step
        else:
            higher = step.select(F.col("bucket").alias("above"), F.col("above").alias("next"), F.col("places").alias("more"))
            maps = maps.join(higher, "above").select("bucket", F.col("next").alias("above"), F.transform("places", lambda s: F.get("more", s)).alias("places"))
        sums = up.filter("sums is not null").select(F.col("above").alias("bucket"), "sums")
    owner = placed.select("h1", "h2", "bucket", "slot")
    if maps is None:
        owner = owner.select("h1", "h2", F.col("slot").alias("shard"))
    else:
        owner = owner.join(maps.select("bucket", "places"), "bucket").select("h1", "h2", F.get("places", F.col("slot")).alias("shard"))
    out = written(sized.join(owner, ["h1", "h2"]).select("doc_id", "bytes", "shard"), "shards")
    forget(*tables)
    return out
