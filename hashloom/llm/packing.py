"""Hierarchical multi-length packing.

Documents are measured in tokens and routed to the smallest of several context sizes
(tiers) that holds them; longer ones than the longest tier are cut.  Tiers are packed
from the longest to the shortest: a window is opened with the longest piece left in its
tier and filled with the longest that still fit, first from its own tier, then, for
the gap that remains, from the shorter ones.  A tier's windows are then dealt to step
groups of equal token budgets so that each group's fill comes out even.

Packing is by bucket, a hash of doc_id, and the number of buckets follows the
tokens, so no task holds more than about `bucket_tokens`; only ids and lengths move.
"""

from __future__ import annotations

import math
from bisect import bisect_right, insort

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_arrow, written

TIERS = (512, 2048, 8192)
STEP_TOKENS = 65536
BUCKET_TOKENS = 8_000_000
SCHEMA = "doc_id bigint, piece int, first_token bigint, tokens bigint, bucket int, tier int, window int, slot int, window_offset int, step int"


def token_counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, tokens): runs of non-blanks plus one end mark; with tokenizer_path
    (a tokenizers JSON file that all executors can read) its ids plus one.  Texts without
    words, and rows without doc_id, are left out."""

    def run(batches):
        tokenizer = None
        if tokenizer_path:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_path)
            tokenizer.encode_special_tokens = True
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            if tokenizer is None:
                n = pc.count_substring_regex(texts, r"[^ \t\n\r\f\v]+")
            else:
                n = pa.array([len(tokenizer.encode(t, add_special_tokens=False).ids) if t.strip() else 0 for t in texts.to_pylist()])
            n = n.cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.add(n, 1)], names=["doc_id", "tokens"]).filter(pc.greater(n, 0))

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null")
    return map_arrow(picked, run, "doc_id bigint, tokens bigint")


def pack_pieces(lengths: list[int], tiers: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """For each piece (tier, window, slot, offset); lengths are at most the longest tier."""
    tiers = tuple(sorted(tiers))
    left: list[dict[int, list[int]]] = [{} for _ in tiers]  # by tier: length -> pieces, the first one last
    for k in range(len(lengths) - 1, -1, -1):
        t = next(i for i, size in enumerate(tiers) if lengths[k] <= size)
        left[t].setdefault(lengths[k], []).append(k)
    order = [sorted(d) for d in left]

    def take(t: int, most: int) -> int:
        at = bisect_right(order[t], most) - 1
        if at < 0:
            return -1
        size = order[t][at]
        pieces = left[t][size]
        k = pieces.pop()
        if not pieces:
            del left[t][size]
            order[t].pop(at)
        return k

    out: list = [None] * len(lengths)
    for t in range(len(tiers) - 1, -1, -1):
        window = 0
        while order[t]:
            used = slot = 0
            for source in range(t, -1, -1):
                while order[source] and (k := take(source, tiers[t] - used)) >= 0:
                    out[k] = (tiers[t], window, slot, used)
                    used += lengths[k]
                    slot += 1
            window += 1
    return out


def balance_steps(fill: list[int], per_step: int) -> list[int]:
    """A step group for each window: ceil(n / per_step) groups of at most per_step
    windows; the fullest windows first, each to the emptiest group with room."""
    groups = math.ceil(len(fill) / per_step)
    free = [(0, 0, g) for g in range(groups)]  # tokens, windows, group
    step = [0] * len(fill)
    for w in sorted(range(len(fill)), key=lambda w: (-fill[w], w)):
        tokens, n, g = free.pop(0)
        step[w] = g
        if n + 1 < per_step:
            insort(free, (tokens + fill[w], n + 1, g))
    return step


def pack(
    docs: DataFrame,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    bucket_tokens: int = BUCKET_TOKENS,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """Where each piece of each document goes:

    (doc_id, piece, first_token, tokens, bucket, tier, window, slot, window_offset, step).
    A window is named by bucket, tier and window, a step group by bucket, tier and
    step.  Every token of every document is in one piece.  Null ids and texts without
    words are left out; each of several rows with one doc_id is packed (as pieces that
    are alike but for their place); equal lengths go by doc_id.  Other columns are
    not read; an empty table gives no rows.
    """
    tiers = tuple(sorted(tiers))
    longest = tiers[-1]
    counts = written(token_counts(docs, tokenizer_path), "token-counts")
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_tokens))
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / longest).cast("int")))
    pieces = (
        counts.select("doc_id", "tokens", cut.alias("piece"))
        .withColumn("first_token", F.col("piece").cast("bigint") * longest)
        .withColumn("tokens", F.least(F.col("tokens") - F.col("first_token"), F.lit(longest)).cast("bigint"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        placed = pd.DataFrame(pack_pieces(pdf["tokens"].tolist(), tiers), columns=["tier", "window", "slot", "window_offset"])
        out = pd.concat([pdf, placed], axis=1)
        out["step"] = 0
        for tier, part in out.groupby("tier"):
            fill = part.groupby("window")["tokens"].sum().sort_index().tolist()
            step = balance_steps(fill, max(1, step_tokens // tier))
            out.loc[part.index, "step"] = part["window"].map(dict(enumerate(step))).astype(int)
        return out[[c.split()[0] for c in SCHEMA.split(", ")]]

    ship_package(docs.sparkSession)
    return pieces.select("doc_id", "piece", "first_token", "tokens", "bucket").groupBy("bucket").applyInPandas(run, SCHEMA)
