"""Long repeated spans by de Bruijn compaction.

Words are runs of non-blanks.  A span is repeated where each run of `min_words`
words in it also stands in another document.

1. Every run of min_words words has one smallest k-mer hash (its anchor).  Anchors that only
   one document has rule their runs out; nothing else of such text is looked at again.
2. The runs that are left are the edges of a de Bruijn graph, from the node of
   their first min_words-1 words to that of their last.  Edges that stand in two documents
   or more stay.
3. Nodes with one way in and one way out are compacted away by joins: neighbouring
   edges of one document first, then paths across documents by pointer doubling.
4. The paths are found again in each document's coordinates.  There, places that
   follow each other on one path are intervals, and intervals that touch are a span.

Documents with equal texts are one text up to the last step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, map_arrow, sized_broadcast, split_words, written

MIN_WORDS = 50
WINDOW = 32  # k-mers in a run; a power of two
_BASE = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_INVERSE = [pow(int(b), -1, 1 << 64) for b in _BASE]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """(2, n) hashes of words."""
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = coded.dictionary.to_pylist()
    table = np.array([[xxhash.xxh64_intdigest(w, seed) for w in words] for seed in (1, 2)], np.uint64).reshape(2, -1)
    return table[:, coded.indices.to_numpy(zero_copy_only=False)]


class Runs:
    """Hashes of all runs of n words of a stretch of words."""

    def __init__(self, hashes: np.ndarray):
        n = hashes.shape[1]
        self.n = n
        self.sums, self.back = [], []
        for row, base, inverse in zip(hashes, _BASE, _INVERSE):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)])[: n + 1])
            self.back.append(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(inverse))])[: n + 1]))
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(row * power[:n])]))

    def of(self, size: int, which: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Hash number `which` of the runs of `size` words that lie in [start, end)."""
        end = self.n if end is None else end
        a = self.sums[which]
        return _mix((a[start + size : end + 1] - a[start : end + 1 - size]) * self.back[which][start : end + 1 - size] + np.uint64(size))


def smallest(x: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each `window` (a power of two) values in a row."""
    size = 1
    while size < window:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x


def _signatures(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, n, t1, t2, anchors) of texts of at least min_words words."""
    k = min_words - WINDOW + 1

    def run(batches):
        for b in batches:
            flat, offsets = split_words(b.column(1))
            ids = b.column(0).to_pylist()
            h = word_hashes(flat)
            rows = []
            for r, (lo, hi) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                if hi - lo < min_words:
                    continue
                runs = Runs(h[:, lo:hi])
                n = hi - lo
                anchors = np.unique(smallest(runs.of(k, 0), WINDOW))
                rows.append((ids[r], n, runs.of(n, 0)[0].astype(np.int64), runs.of(n, 1)[0].astype(np.int64), anchors.astype(np.int64)))
            cols = list(zip(*rows)) if rows else [[] for _ in range(5)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n", "t1", "t2", "anchors"])

    return map_arrow(docs, run, "doc_id bigint, n bigint, t1 bigint, t2 bigint, anchors array<bigint>")


def _runs(docs: DataFrame, shared: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, at, nodes): stretches of edges whose anchor several texts have, as the
    nodes that they pass; edge number i goes from node i to node i + 1 and stands at at + i."""
    k = min_words - WINDOW + 1

    def run(batches):
        for b in batches:
            flat, offsets = split_words(b.column(1))
            ids, lists = b.column(0).to_pylist(), b.column(2)
            h = word_hashes(flat)
            rows = []
            for r, (lo, hi) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                if hi - lo < min_words:
                    continue
                runs = Runs(h[:, lo:hi])
                known = np.asarray(lists[r].values.to_numpy(), np.int64).astype(np.uint64)
                at = np.flatnonzero(np.isin(smallest(runs.of(k, 0), WINDOW), known))
                node = runs.of(min_words - 1, 0).astype(np.int64)
                for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    if len(part):
                        rows.append((ids[r], int(part[0]), node[part[0] : part[-1] + 2]))
            cols = list(zip(*rows)) if rows else [[], [], []]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "at", "nodes"])

    ids = shared.select(F.col("doc_id").alias("__id"))
    few = docs.join(sized_broadcast(ids, 16), docs["doc_id"] == F.col("__id"), "left_semi")
    return map_arrow(few.join(shared, "doc_id").select("doc_id", "text", "hashes"), run, "doc_id bigint, at bigint, nodes array<bigint>")


def _edges(runs: DataFrame) -> DataFrame:
    """(doc_id, at, src, dst) of each edge of each run.  The two nodes, which are hashes of
    49 words each, name the 50 words together."""
    n = F.size("nodes") - 1
    pairs = F.zip_with(F.slice("nodes", F.lit(1), n), F.slice("nodes", F.lit(2), n), lambda s, d: F.struct(s.alias("src"), d.alias("dst")))
    each = runs.select("doc_id", "at", F.posexplode(pairs).alias("i", "e"))
    return each.select("doc_id", (F.col("at") + F.col("i")).alias("at"), "e.src", "e.dst")


def compact(edges: DataFrame) -> DataFrame:
    """(src, dst, least, path) for distinct edges (src, dst, doc, at): path is the place
    (doc, at) of the first edge of the unbranched path an edge is on, least is doc.

    An edge is named by the first place where it stands.  On a circle without
    branches there is no first edge; its edges keep some place on it.
    """
    place = F.struct("doc", "at")
    ends = edges.select(F.col("src").alias("node"), place.alias("out"), F.lit(None).cast("struct<doc:bigint,at:bigint>").alias("in")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(None).cast("struct<doc:bigint,at:bigint>").alias("out"), place.alias("in"))
    )
    links = (
        ends.groupBy("node")
        .agg(F.count("out").alias("n_out"), F.count("in").alias("n_in"), F.max("out").alias("out"), F.max("in").alias("in"))
        .filter("n_out = 1 and n_in = 1")
        .select(F.col("out.doc").alias("doc"), F.col("out.at").alias("at"), F.col("in").alias("before"))
    )
    by_doc = W.partitionBy("doc").orderBy("at")
    follows = F.coalesce((F.col("before.doc") == F.col("doc")) & (F.col("before.at") == F.col("at") - 1), F.lit(False))
    linked = (
        edges.join(links, ["doc", "at"], "left")
        .withColumn("first", F.last(F.when(~follows, F.col("at")), ignorenulls=True).over(by_doc))
        .select("src", "dst", "doc", "at", "first", "before", (~follows).alias("starts"))
    )
    pieces = written(linked, "pieces")
    # piece -> the piece that its path comes from, in another document or elsewhere in this one
    jumps = pieces.filter("starts and before is not null").select(F.col("doc").alias("p_doc"), F.col("at").alias("p_at"), F.col("before.doc").alias("doc"), F.col("before.at").alias("at"))
    up = written(jumps.join(pieces.select("doc", "at", "first"), ["doc", "at"]).select("p_doc", "p_at", F.col("doc").alias("u_doc"), F.col("first").alias("u_at")), "jumps")
    tables = [pieces]
    n = up.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        higher = up.select(F.col("p_doc").alias("u_doc"), F.col("p_at").alias("u_at"), F.col("u_doc").alias("v_doc"), F.col("u_at").alias("v_at"))
        after = written(
            up.join(higher, ["u_doc", "u_at"], "left").select(
                "p_doc", "p_at", F.coalesce("v_doc", "u_doc").alias("u_doc"), F.coalesce("v_at", "u_at").alias("u_at"), F.col("v_doc").isNotNull().alias("moved")
            ),
            "jumps",
        )
        forget(up)
        up = after
        if up.filter("moved").isEmpty():
            break
    tables.append(up)
    roots = up.select(F.col("p_doc").alias("doc"), F.col("p_at").alias("first"), "u_doc", "u_at")
    out = written(
        pieces.join(roots, ["doc", "first"], "left").select(
            "src", "dst", F.col("doc").alias("least"), F.struct(F.coalesce("u_doc", "doc").alias("doc"), F.coalesce("u_at", "first").alias("at")).alias("path")
        ),
        "paths",
    )
    forget(*tables)
    return out


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id) of the spans of each document of
    which every word is in a run of min_words words that another document has too.

    Words count from 0, the end is exclusive; first_doc_id is the smallest doc_id
    with any of the span's repeated runs.  Null ids are left out; null, empty and
    shorter texts have no spans.  Rows with one doc_id are one document: what only
    they share is not repeated, and a row that stands there twice counts once.  Other
    columns are not read; an empty table gives no rows.
    """
    if min_words < WINDOW + 2:
        raise ValueError(f"min_words must be at least {WINDOW + 2}")
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    signs = written(_signatures(picked, min_words), "signatures")
    texts = signs.groupBy("t1", "t2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"))
    reps = written(texts.select("t1", "t2", "n", "rep", (F.col("top") > F.col("rep")).alias("copied")), "texts")
    own = reps.select(F.col("rep").alias("doc_id"), "t1", "t2", "n")
    anchors = signs.join(own, ["doc_id", "t1", "t2", "n"], "left_semi").select("doc_id", F.explode("anchors").alias("h"))
    several = anchors.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("h")
    shared = written(anchors.join(several, "h").groupBy("doc_id").agg(F.collect_set("h").alias("hashes")), "shared")
    runs = written(_runs(picked, shared, min_words), "runs")
    forget(shared)
    kept = written(
        _edges(runs)
        .groupBy("src", "dst")
        .agg(F.min(F.struct("doc_id", "at")).alias("p"), F.max("doc_id").alias("most"))
        .filter("p.doc_id <> most")
        .select("src", "dst", F.col("p.doc_id").alias("doc"), F.col("p.at").alias("at")),
        "kept",
    )
    paths = compact(kept)
    forget(kept)
    by_doc = W.partitionBy("doc_id").orderBy("at")
    places = _edges(runs).join(paths, ["src", "dst"]).drop("src", "dst")
    # where one path is followed word by word
    step = places.withColumn("new", (F.coalesce(F.lag("at").over(by_doc) != F.col("at") - 1, F.lit(True)) | F.coalesce(F.lag("path").over(by_doc) != F.col("path"), F.lit(True))).cast("int"))
    numbered = step.withColumn("part", F.sum("new").over(by_doc))
    intervals = numbered.groupBy("doc_id", "part").agg(F.min("at").alias("lo"), (F.max("at") + min_words).alias("hi"), F.min("least").alias("least"))
    by_lo = W.partitionBy("doc_id").orderBy("lo", "hi")
    reach = F.max("hi").over(by_lo.rowsBetween(W.unboundedPreceding, -1))
    spans = (
        intervals.withColumn("new", F.coalesce(reach < F.col("lo"), F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(by_lo.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc_id", "span")
        .agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"), F.min("least").alias("first_doc_id"))
    )
    spans = written(spans.drop("span"), "spans")
    # a copied text is repeated from end to end, for each of its copies
    copied = reps.filter("copied").select("t1", "t2", "n", "rep")
    sources = spans.groupBy("doc_id").agg(F.min("first_doc_id").alias("least"))
    firsts = copied.join(sources, copied["rep"] == sources["doc_id"], "left").select("t1", "t2", "n", F.least("rep", "least").alias("first_doc_id"))
    full = (
        signs.select("doc_id", "t1", "t2", "n").distinct()
        .join(firsts, ["t1", "t2", "n"])
        .select("doc_id", F.lit(0).cast("bigint").alias("start_word"), F.col("n").alias("end_word"), "first_doc_id")
    )
    part = spans.join(copied.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    out = written(part.select("doc_id", "start_word", "end_word", "first_doc_id").unionByName(full), "repeats")
    forget(signs, reps, runs, paths, spans)
    return out


ORACLE_SQL = f"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), runs AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + {MIN_WORDS}], ' ')) AS s
  FROM words, unnest(range(0, len(w) - {MIN_WORDS - 1})) AS u(i)
), repeated AS (
  SELECT s, min(doc_id) AS least FROM runs GROUP BY s HAVING count(DISTINCT doc_id) > 1
), places AS (
  SELECT DISTINCT doc_id, i, least FROM runs JOIN repeated USING (s)
), marked AS (
  SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {MIN_WORDS} THEN 0 ELSE 1 END AS fresh FROM places
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked
)
SELECT doc_id, min(i)::BIGINT AS start_word, (max(i) + {MIN_WORDS})::BIGINT AS end_word, min(least) AS first_doc_id
FROM numbered GROUP BY doc_id, span
"""
