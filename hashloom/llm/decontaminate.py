"""Benchmark decontamination: a BM25 index of the test items, queried by every
passage of the training documents.

The index's terms are pairs of adjacent words.  A posting holds the share that a
term has in its item's BM25 score against itself, so a passage's score for an item
lies between 0 and 1 and one threshold fits all items.  Postings are cut into
blocks with their maximum; block-max WAND retrieves every item whose score reaches
the threshold.  A retrieved item counts as leaked if the passage holds enough of its
question and of its answer.

Items and passages go through the same `tokens`.  Document frequencies and shares are made by
Spark; the postings fall into index shards by item, of ITEMS items each.  A passage is only
queried in a shard if the largest shares that its terms have there together reach the threshold, as
no item can score more than that.  The terms' hashes with these maxima are all that is
broadcast.  The passages meet their shards' postings in tasks of bounded size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_arrow, sized_broadcast, tokens, without, written

K1, B = 1.2, 0.75
BLOCK = 16
THETA = 0.5
OVERLAP = 0.5
#: Passages have at least so many words; each overlaps the next by half.
PASSAGE_WORDS = 128
#: Items of an index shard, and passages that meet one in a task.
ITEMS, PASSAGES = 4096, 20000
#: Bytes of term bounds that are broadcast at once: about 70,000 items.
LIMIT = 64 << 20
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
SCHEMA = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint"
_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[str]:
    return tokens([text])[0].to_pylist()


def pair_hashes(flat: pa.Array) -> np.ndarray:
    """The terms: hashes of each word with the next (one fewer than words)."""
    coded = flat.dictionary_encode()
    word = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]
    x = word[:-1] * _A + (word[1:] ^ (word[1:] >> np.uint64(32))) * _C
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words, cut before its last sentences: the answer is the shortest
    run of whole last sentences with at least five words and a fifth of all;
    where that leaves no question, it is the last quarter of the words."""
    words = words_of(text)
    flat, offsets = tokens(_SENTENCE.split(text))
    sizes = [n for n in np.diff(offsets).tolist() if n]
    size, at = 0, len(sizes)
    while at > 0 and size < max(5, len(words) / 5):
        at -= 1
        size += sizes[at]
    if size >= len(words) or sum(sizes) != len(words):
        size = max(1, len(words) // 4)
    return words[: len(words) - size], words[len(words) - size :]


def item_terms(text: str) -> list[tuple]:
    """(term, tf, in question, in answer, length of its shorter word, of both) of an item; none with fewer than two words."""
    q, a = question_and_answer(text)
    words = q + a
    if len(words) < 2:
        return []
    terms = pair_hashes(pa.array(words, pa.large_string())).tolist()
    tf = Counter(terms)
    in_q, in_a = set(terms[: max(1, len(q) - 1)]), set(terms[len(q) - 1 if len(q) > 1 else 0 :])
    size = {t: (min(len(x), len(y)), len(x) + len(y)) for t, x, y in zip(terms, words, words[1:])}
    return [(t, n, t in in_q, t in in_a, *size[t]) for t, n in tf.items()]


@dataclass
class Index:
    """Of some items: postings by term, with their blocks' maxima."""

    keys: np.ndarray  # terms, sorted
    postings: list[tuple[list[int], list[float]]]
    block_max: list[list[float]]
    most: list[float]
    #: by item number: (item_id, version, terms of the question, of the answer), as places in keys
    items: list[tuple[int, int, frozenset, frozenset]]


def build_index(item_id: np.ndarray, version: np.ndarray, term: np.ndarray, share: np.ndarray, in_q: np.ndarray, in_a: np.ndarray) -> Index:
    """From posting rows; an item is an item_id and a version of its text."""
    order = np.lexsort((term, version, item_id))
    item_id, version, term, share, in_q, in_a = (x[order] for x in (item_id, version, term, share, in_q, in_a))
    new = np.ones(len(term), bool)
    new[1:] = (item_id[1:] != item_id[:-1]) | (version[1:] != version[:-1])
    number = np.cumsum(new) - 1
    keys, at = np.unique(term, return_inverse=True)
    starts = np.append(np.flatnonzero(new), len(term))
    items = []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        t = at[lo:hi]
        items.append((int(item_id[lo]), int(version[lo]), frozenset(t[in_q[lo:hi]].tolist()), frozenset(t[in_a[lo:hi]].tolist())))
    by_term = np.lexsort((number, at))
    ends = np.append(np.flatnonzero(np.diff(at[by_term], prepend=-1)), len(at))
    postings = [(number[by_term[lo:hi]].tolist(), share[by_term[lo:hi]].tolist()) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]
    block_max = [[max(s[i : i + BLOCK]) for i in range(0, len(s), BLOCK)] for _, s in postings]
    return Index(keys, postings, block_max, [max(m) for m in block_max], items)


def block_max_wand(index: Index, terms: list[int], theta: float) -> list[tuple[int, float]]:
    """(item number, score) of every item that scores at least theta for a query
    of these distinct terms."""
    theta -= 1e-9
    cursors = [[index.postings[t][0][0], 0, t] for t in terms]  # [item, place, term]
    found = []

    def advance(c: list, to: int) -> None:
        ids = index.postings[c[2]][0]
        at = c[1]
        # whole blocks first
        while at < len(ids) and ids[min((at // BLOCK + 1) * BLOCK, len(ids)) - 1] < to:
            at = (at // BLOCK + 1) * BLOCK
        while at < len(ids) and ids[at] < to:
            at += 1
        c[1] = at
        c[0] = ids[at] if at < len(ids) else -1

    def block_of(c: list, item: int) -> tuple[float, int]:
        """The maximum of the block that would hold item, and that block's last item."""
        ids = index.postings[c[2]][0]
        b = c[1] // BLOCK
        while ids[min((b + 1) * BLOCK, len(ids)) - 1] < item:
            b += 1
            if b * BLOCK >= len(ids):
                return 0.0, 1 << 60
        return index.block_max[c[2]][b], ids[min((b + 1) * BLOCK, len(ids)) - 1]

    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += index.most[c[2]]
            if bound >= theta:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        inside = [block_of(c, item) for c in cursors[: pivot + 1]]
        if sum(m for m, _ in inside) >= theta:
            if cursors[0][0] == item:
                score = sum(index.postings[c[2]][1][c[1]] for c in cursors[: pivot + 1])
                if score >= theta:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    advance(c, item + 1)
            else:
                for c in cursors[: pivot + 1]:
                    if c[0] < item:
                        advance(c, item)
        else:
            # no item up to the nearest block end can reach theta
            to = min(last for _, last in inside) + 1
            if pivot + 1 < len(cursors):
                to = min(to, cursors[pivot + 1][0])
            to = max(to, item + 1)
            for c in cursors[: pivot + 1]:
                if c[0] < to:
                    advance(c, to)
        cursors = [c for c in cursors if c[0] >= 0]
    return found


def leaks_in(index: Index, held: np.ndarray, theta: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(item_id, version, score, question overlap, answer overlap) of each item leaked into a passage that holds these distinct terms."""
    at = np.minimum(np.searchsorted(index.keys, held), len(index.keys) - 1)
    terms = at[index.keys[at] == held].tolist()
    inside, out = set(terms), []
    for n, _ in block_max_wand(index, terms, theta):
        item_id, version, q, a = index.items[n]
        qo, ao = len(q & inside) / len(q), len(a & inside) / len(a)
        if qo >= overlap and ao >= overlap:
            # In the order of the terms, so that equal passages score alike.
            score = sum(s for t in sorted(q | a) if t in inside for s in [index.postings[t][1][index.postings[t][0].index(n)]])
            out.append((item_id, version, score, qo, ao))
    return out


@dataclass
class Bounds:
    """The largest share of each term in each index shard: rows by term."""

    term: np.ndarray
    shard: np.ndarray
    most: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.term, kind="stable")
        self.term, self.shard, self.most = self.term[order], self.shard[order], self.most[order]
        self.distinct, self.first = np.unique(self.term, return_index=True)
        self.first = np.append(self.first, len(self.term))


def passages(flat: pa.Array, offsets: np.ndarray, bounds: Bounds, width: int, theta: float):
    """(text, first word, terms, shard) of each passage and shard in which it could reach theta."""
    if len(flat) < 2 or not len(bounds.term):
        return
    term = pair_hashes(flat)
    inner = np.ones(len(term), bool)
    ends = offsets[1:-1]
    inner[ends[(ends > 0) & (ends < len(flat))] - 1] = False  # a pair doesn't reach into the next text
    at = np.minimum(np.searchsorted(bounds.distinct, term), len(bounds.distinct) - 1)
    marked = np.flatnonzero((bounds.distinct[at] == term) & inner)
    rows = np.searchsorted(offsets, marked, side="right") - 1
    step = width // 2
    place = marked - offsets[rows]
    last = place // step  # the last passage that holds it; the one before does too, but for its final word
    before = (last > 0) & (place - (last - 1) * step < width - 1)
    most = int(last.max()) + 1 if len(last) else 1
    number = np.concatenate([rows * most + last, (rows * most + last - 1)[before]])
    held = np.concatenate([at[marked], at[marked][before]])
    passage, where = np.unique(number, return_inverse=True)
    once = np.unique(where * len(bounds.distinct) + held)
    where, held = once // len(bounds.distinct), once % len(bounds.distinct)
    n = bounds.first[held + 1] - bounds.first[held]
    row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds.first[held], n)
    shards, which = np.unique(bounds.shard[row], return_inverse=True)
    pairs, group = np.unique(np.repeat(where, n) * len(shards) + which, return_inverse=True)
    for k in pairs[np.bincount(group, bounds.most[row], minlength=len(pairs)) >= theta - 1e-6].tolist():
        r, s = divmod(int(passage[k // len(shards)]), most)
        lo, hi = int(offsets[r]) + s * step, int(offsets[r + 1]) - 1
        yield r, s * step, np.unique(term[lo : min(hi, lo + width - 1)]), int(shards[k % len(shards)])


def postings(benchmark: DataFrame, theta: float, items_a_shard: int) -> tuple[DataFrame, int]:
    """Written (shard, item_id, version, term, share, in_q, in_a), and the width of passages."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()

    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = item_terms(t)
                pairs, words = sum(r[1] for r in rows), len(words_of(t))
                out += [(i, xxhash.xxh64_intdigest(t) - (1 << 63), pairs, words, *r) for r in rows]
            cols = list(zip(*out)) if out else [[] for _ in range(10)]
            kinds = (*[pa.int64()] * 6, pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["item_id", "version", "pairs", "words", "term", "tf", "in_q", "in_a", "shorter", "both"])

    schema = "item_id bigint, version bigint, pairs bigint, words bigint, term bigint, tf bigint, in_q boolean, in_a boolean, shorter bigint, both bigint"
    raw = written(map_arrow(items, run, schema), "item-terms")
    n, total, longest = raw.select("item_id", "version", "pairs", "words").distinct().agg(F.count("*"), F.sum("pairs"), F.max("words")).first()
    width = max(PASSAGE_WORDS, 2 * (longest or 0))
    df = raw.groupBy("term").agg(F.count("*").alias("df"))
    item = W.partitionBy("item_id", "version")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("pairs") / F.lit((total or 1) / max(n, 1)))
    shares = raw.join(df, "term").withColumn("raw", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).withColumn("share", F.col("raw") / F.sum("raw").over(item))
    shard = F.pmod(F.xxhash64("item_id", "version"), F.lit(max(1, math.ceil(n / items_a_shard)))).cast("int")
    out = shares.select(shard.alias("shard"), "item_id", "version", "term", "share", "in_q", "in_a")
    return written(out, "postings"), width


def find_leaks(docs: DataFrame, benchmark: DataFrame, theta: float = THETA, overlap: float = OVERLAP, limit: int = LIMIT, items_a_shard: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of each
    benchmark item that leaked into each row of docs: its best passage, of equal ones the first.

    At most about `limit` bytes of term bounds are broadcast (20 a term); those of a larger benchmark are
    broadcast in parts, and docs is read once for each.  Null and empty texts hold no
    passage; items with null id or text, or with fewer than two words, match
    nothing; items with one id are told apart by text.  A text of any length is read whole.  A null
    doc_id is returned as null, repeated rows each report their leaks, other columns are not read, and
    an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    index_rows, width = postings(benchmark, theta, items_a_shard)
    most = written(index_rows.groupBy("shard", "term").agg(F.max("share").alias("most")), "bounds")
    n = most.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    parts = max(1, math.ceil(20 * n / limit))
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    candidates = "part int, shard int, doc_id bigint, h1 bigint, h2 bigint, start bigint, terms array<bigint>"

    def probe(part: int) -> DataFrame:
        rows = most.filter(F.col("shard") % parts == part).toArrow()
        known = spark.sparkContext.broadcast(Bounds(*(rows.column(c).to_numpy() for c in ("term", "shard", "most"))))

        def run(batches):
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                out = []
                for r, s, held, shard in passages(*tokens(texts), known.value, width, theta):
                    h = xxhash.xxh128_intdigest(texts[r].encode("utf-8", "replace"))
                    out.append((part, shard, ids[r], (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), s, held))
                cols = list(zip(*out)) if out else [[] for _ in range(7)]
                kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in candidates.split(", ")])

        return map_arrow(picked, run, candidates)

    found = probe(0)
    for part in range(1, parts):
        found = found.unionByName(probe(part))
    found = written(found, "passages")
    salts = sized_broadcast(found.groupBy("shard").agg(F.ceil(F.count("*") / PASSAGES).cast("int").alias("salts")), 8)
    queries = found.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "h1", "start"), F.col("salts")).cast("int")).drop("salts")
    index = index_rows.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    index = index.select("shard", "salt", "item_id", "version", "term", "share", "in_q", "in_a")
    hits = "part int, doc_id bigint, h1 bigint, h2 bigint, start bigint, item_id bigint, version bigint, score double, question_overlap double, answer_overlap double"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            built = build_index(*(left.column(c).to_numpy() for c in ("item_id", "version", "term", "share", "in_q", "in_a")))
            names = right.select(["part", "doc_id", "h1", "h2", "start"]).to_pylist()
            lists = right.column("terms").combine_chunks()
            flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            for k, name in enumerate(names):
                out += [(*name.values(), *x) for x in leaks_in(built, flat[ends[k] : ends[k + 1]], theta, overlap)]
        cols = list(zip(*out)) if out else [[] for _ in range(10)]
        kinds = (pa.int32(), *[pa.int64()] * 6, *[pa.float64()] * 3)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in hits.split(", ")])

    ship_package(spark)
    met = index.groupBy("shard", "salt").cogroup(queries.groupBy("shard", "salt")).applyInArrow(meet, hits)
    # Equal rows find the same passages; how many there are is how often a row stands in docs.
    text, item = ("doc_id", "h1", "h2"), ("item_id", "version")
    best = F.max(F.struct("score", (-F.col("start")).alias("back"), "question_overlap", "answer_overlap")).alias("best")
    each = met.groupBy("part", *text, *item, "start").agg(F.count("*").cast("int").alias("times"), F.first("score").alias("score"), F.first("question_overlap").alias("question_overlap"), F.first("answer_overlap").alias("answer_overlap"))
    leaks = each.groupBy(*text, *item).agg(best, F.max("times").alias("times"))
    return leaks.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("times")))).select(
        "doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap", (-F.col("best.back")).alias("first_word")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the documents that hold a leaked item (by doc_id; rows whose
    doc_id is null stay, and so do null and empty texts; of repeated rows all go or all stay; an empty
    table on either side takes nothing away)."""
    return without(docs, written(find_leaks(docs, benchmark, **how).select("doc_id").distinct(), "leaks"))
