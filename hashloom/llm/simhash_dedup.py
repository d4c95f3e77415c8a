"""Near duplicates by SimHash and BK-trees.

1. A document's fingerprint has 128 bits over its distinct words, and 128 more
   over its distinct word pairs.  Documents with equal fingerprints and keys are one node.
2. A text's keys are the smallest hashes of its runs of RUN_WORDS words, under KEYS hash
   functions.  Two texts can be linked if they share SHARED keys; that depends on nothing
   but the two, whatever else is in the table.  A shard holds the nodes that have one key in
   common.  If these are more than CELL, as with a line that many documents repeat, a shard
   holds those that have two such keys in common, and then SHARED of them.
3. A shard becomes a BK-tree over the first half of the fingerprints (children keyed by the
   integer Hamming distance to the parent).  For every node only the edges within the
   radius are followed.  A match must also be near in the second half.
4. Matches are edges; connected components are the groups.

So two texts are linked if both halves are within their radii and SHARED keys are the same.
Word pairs within their radius are about half the same, and then so many shared keys are all but certain.

A shard of SHARED keys that still has more than CELL nodes is cut up: what is near its first
node is one component at once; the others, in chunks of at most CELL, meet each other and
the rest chunk by chunk, two chunks in a task.  No pair of unlike components goes untried.

The shards' trees stay where their nodes meet instead of being broadcast: all of
them together are as large as the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, map_arrow, sized_broadcast, split_words, written

RADIUS = 24
PAIR_RADIUS = 32
RUN_WORDS = 4
KEYS = 16
SHARED = 3
#: The nodes of a chunk; a task holds two chunks of a shard.
CELL = 4096
#: Rows of bits that are summed at once, and pairs that are compared at once.
STEP, FRONT = 1 << 15, 1 << 17
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xC2B2AE3D27D4EB4F)
_FP = "a bigint, b bigint, c bigint, d bigint"
_FP_SCHEMA = f"doc_id bigint, {_FP}, keys array<bigint>"
_SEEDS = np.random.default_rng(5).integers(0, 1 << 63, KEYS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M
    x = (x ^ (x >> np.uint64(32))) * _N
    return x ^ (x >> np.uint64(31))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.diff(x, prepend=x[0] - 1) != 0]


def _majorities(owner: np.ndarray, digests: np.ndarray, n: int) -> np.ndarray:
    """(n, 16) bytes: for each owner (in ascending order) the bits that are set in more than half of its digests."""
    sums = np.zeros((n, 128), np.int64)
    for lo in range(0, len(owner), STEP):
        o = owner[lo : lo + STEP]
        first = np.flatnonzero(np.diff(o, prepend=-1))
        # Each bit becomes a byte, and eight of those are added at once: up to 255 rows don't overflow.
        at = np.union1d(first, np.arange(0, len(o), 255))
        part = np.add.reduceat(np.unpackbits(digests[lo : lo + STEP], axis=1).view(np.uint64), at, axis=0).view(np.uint8)
        np.add.at(sums, o[at], part)
    return np.packbits(2 * sums > np.bincount(owner, minlength=n)[:, None], axis=1)


def prints_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, fingerprints, keys) of the texts that have a word: their numbers, (n, 4) integers (128 bits of
    the distinct words, 128 of the distinct pairs of adjacent words; a lone word pairs
    with itself) and (n, KEYS) integers."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{M}\p{N}_]+", " ")
    flat, offsets = split_words(plain)
    rows = np.flatnonzero(np.diff(offsets))
    if not len(rows):
        return rows, np.zeros((0, 4), np.int64), np.zeros((0, KEYS), np.int64)
    lo, hi, n = offsets[rows], offsets[rows + 1], len(rows)
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    digests = np.frombuffer(b"".join([xxhash.xxh128_digest(w) for w in coded.dictionary.to_pylist()]), np.uint8).reshape(-1, 16)
    owner = np.repeat(np.arange(n), hi - lo)
    v = len(digests)
    single = _distinct(owner * v + code)
    first = _majorities(single // v, digests[single % v], n)

    end = np.repeat(hi - lo[0], hi - lo)  # of the text that each word is in
    at = np.arange(len(code))
    lone = np.repeat(hi - lo == 1, hi - lo)
    left = np.flatnonzero((at + 1 < end) | lone)
    right = np.where(lone[left], left, np.minimum(left + 1, len(code) - 1))
    half = digests.view(np.uint64)
    # (text, left, right) as one number, in two steps as it may not fit in 64 bits.
    known, pair = np.unique(code[left] * v + code[right], return_inverse=True)
    both = _distinct(owner[left] * len(known) + pair)
    whose, pairs = both // len(known), known[both % len(known)]
    x, y = half[pairs // v], half[pairs % v]
    pair = np.stack([_mix(x[:, 0] + _M * y[:, 1]), _mix(x[:, 1] + _N * y[:, 0])], axis=1)
    second = _majorities(whose, pair.view(np.uint8).reshape(-1, 16), n)

    words, run = half[:, 0][code], np.zeros(len(code), np.uint64)
    for k in range(RUN_WORDS):
        inside = at + k < end
        run = run * _M + np.where(inside, words[np.minimum(at + k, len(code) - 1)], np.uint64(0)) + np.uint64(k)
    begins = at + RUN_WORDS <= end
    begins[lo - lo[0]] = True  # a shorter text is one run
    run, whose = _mix(run[begins]), owner[begins]
    starts = np.flatnonzero(np.diff(whose, prepend=-1))
    keys = np.stack([np.minimum.reduceat((run ^ s) * _M, starts) for s in _SEEDS], axis=1)
    fps = np.concatenate([first, second], axis=1).view(">i8").astype(np.int64)
    return rows, fps, keys.astype(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b, c, d, keys) for every row with a doc_id and at least one word."""

    def run(batches):
        for batch in batches:
            rows, fps, keys = prints_of(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * KEYS), pa.array(keys.reshape(-1)))
            columns = [batch.column(0).take(pa.array(rows)), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(4)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "b", "c", "d", "keys"])

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    return map_arrow(picked, run, _FP_SCHEMA)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of every integer in the ranges [lo, hi)."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


class BKForest:
    """A BK-tree for each of several shards, over 128-bit values under Hamming distance.

    A node's children are keyed by their distance to it.  Trees are built and searched
    for many values at once, level by level.  Nodes are numbered shard by shard, and a child has a larger
    number than its parent.  On the way down each value is compared with nodes; `met` has
    the pairs that are within the radius.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray, radius: int):
        """values: (n, 2) unsigned; shard: ascending; no value twice in a shard."""
        n = len(values)
        self.values, self.radius = values, radius
        self.parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        roots = np.flatnonzero(np.diff(shard, prepend=-1))
        self.root = np.repeat(roots, np.diff(np.append(roots, n)))
        waiting = np.flatnonzero(self.root != np.arange(n))
        at, met = self.root[waiting], []
        while len(waiting):
            d = _hamming(values[waiting], values[at])
            met.append(np.stack([at, waiting], axis=1)[d <= radius])
            _, first, which = np.unique(at * 129 + d, return_index=True, return_inverse=True)
            self.parent[waiting[first]], edge[waiting[first]] = at[first], d[first]
            at = waiting[first][which]
            on = waiting != at
            waiting, at = waiting[on], at[on]
        self.met = np.concatenate(met) if met else np.zeros((0, 2), np.int64)
        self.kids = np.flatnonzero(self.parent >= 0)
        key = self.parent[self.kids] * 129 + edge[self.kids]
        order = np.argsort(key, kind="stable")
        self.kids, self.key = self.kids[order], key[order]

    def over_subtrees(self, label: np.ndarray) -> np.ndarray:
        """The label that all nodes below and at a node have, or -1."""
        low, high = label.copy(), label.copy()
        depth = np.zeros(len(label), np.int64)
        up = self.parent.copy()
        while (deeper := up >= 0).any():
            depth += deeper
            up = np.where(deeper, self.parent[up], -1)
        by_depth = np.argsort(-depth, kind="stable")
        for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[:-1]:
            np.minimum.at(low, self.parent[level], low[level])
            np.maximum.at(high, self.parent[level], high[level])
        return np.where(low == high, low, -1)

    def pairs(self, queries: np.ndarray, label: np.ndarray):
        """Yields (m, 2) arrays of nodes (smaller number, query) of one shard that are within the
        radius; pairs of nodes with one label (of at least 0) are passed over."""
        yield from self._walk(queries, self.root[queries], label, self.over_subtrees(label))

    def _walk(self, q, v, label, below):
        while len(q):
            if len(q) > FRONT:
                yield from self._walk(q[: len(q) // 2], v[: len(q) // 2], label, below)
                q, v = q[len(q) // 2 :], v[len(q) // 2 :]
                continue
            # What is below has larger numbers; those pairs are found from the other side.
            on = (v < q) & ((below[v] != label[q]) | (label[q] < 0))
            q, v = q[on], v[on]
            d = _hamming(self.values[q], self.values[v])
            near = (d <= self.radius) & ((label[q] != label[v]) | (label[q] < 0))
            yield np.stack([v, q], axis=1)[near]
            lo = np.searchsorted(self.key, v * 129 + np.maximum(d - self.radius, 0))
            hi = np.searchsorted(self.key, v * 129 + np.minimum(d + self.radius, 128), side="right")
            which, place = _spread(lo, hi)
            q, v = q[which], self.kids[place]


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def shard_edges(shard: np.ndarray, fps: np.ndarray, keys: np.ndarray, radius: int, pair_radius: int, shared: int) -> list[tuple[int, int]]:
    """Edges (row, row) that connect the rows of each shard as all its links do: a
    link within what is already connected adds none."""
    if not len(fps):
        return []
    x = fps.view(np.uint64)
    order = np.lexsort((x[:, 1], x[:, 0], shard))
    x, shard, keys = x[order], shard[order], keys[order]
    new = np.concatenate([[True], (shard[1:] != shard[:-1]) | (x[1:, :2] != x[:-1, :2]).any(axis=1)])
    begin = np.append(np.flatnonzero(new), len(x))  # equal first halves share a node of the tree
    node = np.cumsum(new) - 1
    forest = BKForest(x[begin[:-1], :2], shard[begin[:-1]], radius)
    union, edges = _Union(len(x)), []

    def link(i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Joins each row i with those rows in [lo, hi) that it is linked with."""
        total = np.cumsum(hi - lo)
        for part in np.split(np.arange(len(i)), np.searchsorted(total, np.arange(FRONT, total[-1] if len(i) else 0, FRONT))):
            which, other = _spread(lo[part], hi[part])
            one = i[part][which]
            near = np.flatnonzero(_hamming(x[one, 2:], x[other, 2:]) <= pair_radius)
            near = near[(keys[one[near]] == keys[other[near]]).sum(axis=1) >= shared]
            edges.extend((a, b) for a, b in zip(one[near].tolist(), other[near].tolist()) if union.join(a, b))

    def link_nodes(found: np.ndarray) -> None:
        which, row = _spread(begin[found[:, 0]], begin[found[:, 0] + 1])
        link(row, begin[found[which, 1]], begin[found[which, 1] + 1])

    rows = np.arange(len(x))
    several = rows[begin[node + 1] > begin[node] + 1]
    link(several, several + 1, begin[node[several] + 1])
    link_nodes(forest.met)
    label, known = None, -1
    for lo in range(0, len(forest.values), CELL):
        if known != len(edges):
            roots, known = np.array([union.root(k) for k in range(len(x))]), len(edges)
            label = np.where(np.minimum.reduceat(roots, begin[:-1]) == np.maximum.reduceat(roots, begin[:-1]), roots[begin[:-1]], -1)
        for found in forest.pairs(np.arange(lo, min(lo + CELL, len(forest.values))), label):
            link_nodes(found)
    return [(int(order[a]), int(order[b])) for a, b in edges]


def _near_first(rows: DataFrame, nodes: DataFrame, radius: int, pair_radius: int, shared: int) -> tuple[DataFrame, DataFrame]:
    """Written (shard, node, combo, near): whether each node is linked with its shard's first; and the edges of those that are."""
    full = rows.join(nodes, "node")
    first = full.groupBy("shard").agg(F.min_by(F.struct("node", "rep", "a", "b", "c", "d", "keys"), "node").alias("first"))

    def far(*names):
        return sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"first.{n}"))) for n in names), F.lit(0))

    near = (far("a", "b") <= radius) & (far("c", "d") <= pair_radius) & (F.size(F.array_intersect("keys", "first.keys")) >= shared)
    seen = written(
        full.join(sized_broadcast(first, 200), "shard").select("shard", "node", "combo", "rep", F.col("first.rep").alias("first"), (near | (F.col("node") == F.col("first.node"))).alias("near")),
        "hot",
    )
    edges = seen.filter("near and rep <> first").select(F.least("rep", "first").alias("u"), F.greatest("rep", "first").alias("v"))
    return seen, edges


def _cells(seen: DataFrame, cell: int) -> DataFrame:
    """(shard, p, q, node) of shards with more than `cell` nodes: each node in cells (p, q) of two
    chunks, such that all pairs that aren't both near the shard's first node share a cell."""
    chunks = lambda n: F.ceil(n / cell)
    size = seen.groupBy("shard").agg(chunks(F.count_if(~F.col("near"))).alias("others"), chunks(F.count_if("near")).alias("around")).filter("others > 0")
    own = F.when(F.col("near"), F.col("others") + F.pmod(F.xxhash64("node"), "around")).otherwise(F.pmod(F.xxhash64("node"), "others"))
    most = F.when(F.col("near"), F.col("others")).otherwise(F.col("others") + F.col("around"))
    placed = seen.join(sized_broadcast(size, 24), "shard").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), most - 1)))
    return placed.select("shard", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node")


def shards(nodes: DataFrame, radius: int, pair_radius: int, shared: int, cell: int) -> tuple[DataFrame, DataFrame | None]:
    """(shard, p, q, node) of shards of several nodes, in which all links between nodes (node, rep, a, b, c, d,
    keys) meet that are not among the edges, which come second."""
    none = F.lit(0).cast("bigint")
    rows = nodes.select(F.explode("keys").alias("shard"), "node").withColumn("combo", F.array("shard"))
    lists = edges = None
    parts = []
    for level in range(1, shared + 1):
        counts = written(rows.groupBy("shard").count().filter("count > 1"), "shard-counts")
        parts.append(rows.join(counts.filter(F.col("count") <= cell), "shard", "left_semi").select("shard", none.alias("p"), none.alias("q"), "node"))
        hot = counts.filter(F.col("count") > cell).select("shard")
        if hot.isEmpty():
            break
        hot_rows = rows.join(sized_broadcast(hot, 16), "shard", "left_semi")
        if level in (1, shared):
            seen, more = _near_first(hot_rows, nodes, radius, pair_radius, shared)
            edges = more if edges is None else edges.unionByName(more)
            if level == shared:
                parts.append(_cells(seen, cell))
                break
            mixed = seen.groupBy("shard").agg(F.bool_and("near").alias("near")).filter("not near").select("shard")
            hot_rows = seen.join(sized_broadcast(mixed, 16), "shard", "left_semi")
            # All the keys that a link shares are in crowded shards, or it has met already.
            lists = written(hot_rows.groupBy("node").agg(F.collect_set("shard").alias("crowded")).filter(F.size("crowded") >= shared), "crowded")
        longer = hot_rows.join(lists, "node").select("node", "combo", F.explode("crowded").alias("k")).filter(F.col("k") > F.element_at("combo", -1))
        longer = longer.select("node", F.concat("combo", F.array("k")).alias("combo"))
        rows = written(longer.select(F.xxhash64("combo").alias("shard"), "node", "combo"), "crowded-rows")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, edges


def near_edges(nodes: DataFrame, radius: int, pair_radius: int, shared: int = SHARED, cell: int = CELL) -> DataFrame:
    """(u, v) of nodes (node, rep, a, b, c, d, keys): edges that connect them as all their links do."""
    placed, direct = shards(nodes, radius, pair_radius, shared, cell)
    row = F.struct("rep", "a", "b", "c", "d", "keys")
    met = placed.join(nodes, "node").groupBy("shard", "p", "q").agg(F.collect_list(row).alias("nodes")).select("nodes")

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
            rep = flat.field(0).to_numpy()
            fps = np.stack([flat.field(k).to_numpy() for k in range(1, 5)], axis=1)
            keys = flat.field(5).flatten().to_numpy().reshape(len(rep), -1)
            found = shard_edges(np.repeat(np.arange(len(size)), size), fps, keys, radius, pair_radius, shared)
            ends = np.sort(rep[np.array(found, np.int64).reshape(-1, 2)], axis=1)
            ends = ends[ends[:, 0] != ends[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

    found = map_arrow(met, run, "u bigint, v bigint")
    return (found if direct is None else found.unionByName(direct)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Written rows (u, v): v < u is the smallest id that u is connected with.

    Alternating large-star and small-star rounds.  Each is written to the shared
    folder; it ends when a round changes nothing.  The number of rounds grows with
    the logarithm of a component's size.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
        after = written(small.filter("u <> v").distinct(), "edges")
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if seen == state:
            return now
        state = seen


def groups(docs: DataFrame, radius: int = RADIUS, pair_radius: int = PAIR_RADIUS) -> DataFrame:
    """(doc_id, group_id, group_size) of every document that has a near or exact copy.

    group_id is the smallest doc_id of the group and group_size counts distinct
    ids: rows that share a doc_id are one member, which has the copies of each of
    their texts.  Rows with a null doc_id can't be named and are left out, and so are
    null and empty texts and those without words, which have no fingerprint.
    Other columns aren't read; an empty table gives no rows.
    """
    fps = written(fingerprints(docs), "fingerprints")
    same = written(fps.groupBy("a", "b", "c", "d").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")), "same")
    # Of equal fingerprints, texts with other keys are nodes of their own (of the one name).
    unlike = fps.groupBy("a", "b", "c", "d", "keys").agg(F.count("*").alias("n")).join(same, ["a", "b", "c", "d"])
    nodes = written(unlike.select(F.xxhash64("a", "b", "c", "d", "keys").alias("node"), "rep", "a", "b", "c", "d", "keys"), "nodes")
    copies = fps.join(same.filter("top > rep"), ["a", "b", "c", "d"]).filter("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    links = components(near_edges(nodes, radius, pair_radius).unionByName(copies.distinct()))
    members = links.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id"))
    whole = members.unionByName(members.select(F.col("group_id").alias("doc_id"), "group_id").distinct())
    size = members.groupBy("group_id").agg((F.count("*") + 1).alias("group_size"))
    out = written(whole.join(size, "group_id").select("doc_id", "group_id", "group_size"), "groups")
    forget(fps, same, nodes, links)
    return out


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group: that with the smallest doc_id.

    Of rows that share a doc_id one is kept (the first by text).  Rows with a
    null doc_id, and documents without words, are nobody's copies and stay.
    """
    found = groups(docs, **how)
    losers = found.filter("doc_id <> group_id").select(F.col("doc_id").alias("__lost"))
    kept = docs.join(sized_broadcast(losers, 16), docs["doc_id"] == F.col("__lost"), "left_anti")
    twice = written(
        docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__twice")), "twice"
    )
    if twice.isEmpty():
        return kept
    marked = kept.join(sized_broadcast(twice, 16), kept["doc_id"] == F.col("__twice"), "left")
    first = W.partitionBy("doc_id").orderBy("text", F.xxhash64(*[c for c, kind in docs.dtypes if "map" not in kind]))
    one = marked.filter("__twice is not null").withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").drop("__nth")
    return marked.filter("__twice is null").unionByName(one).drop("__twice")
