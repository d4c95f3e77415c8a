import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hashloom.llm import simhash_dedup as S
from llm_data import awkward, documents, prose


def near_copy(rng, text, share=0.03):
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def corpus():
    """(rows, {doc_id: original}): texts of their own, with 0 to 6 near copies each."""
    rng = random.Random(4)
    rows, source = [], {}
    for k in range(60):
        text = prose(rng, rng.randint(60, 400))
        for n in range(1 + k % 7):
            i = len(rows)
            rows.append((i, text if n < 2 else near_copy(rng, text)))
            source[i] = k
    return rows, source


def union(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def prints(texts):
    """{row: (first half, second half, keys)} of the texts that have words."""
    rows, fps, keys = S.prints_of(pa.array(texts, pa.string()))
    halves = [(int.from_bytes(f[:2].astype(">i8").tobytes()), int.from_bytes(f[2:].astype(">i8").tobytes())) for f in fps]
    return {int(r): (*h, k) for r, h, k in zip(rows, halves, keys)}


def within(f, g):
    return (f[0] ^ g[0]).bit_count() <= S.RADIUS and (f[1] ^ g[1]).bit_count() <= S.PAIR_RADIUS


def linked(f, g):
    return within(f, g) and sum(f[2] == g[2]) >= S.SHARED


def all_links(rows, rule=linked):
    p = prints([t for _, t in rows])
    return [(rows[i][0], rows[j][0]) for i in p for j in p if i < j and (rows[i][1] == rows[j][1] or rule(p[i], p[j]))]


def test_groups_are_those_of_all_links(spark):
    rows, source = corpus()
    got = {r.doc_id: r.group_id for r in S.groups(documents(spark, rows)).collect()}
    assert got == union(all_links(rows))
    # of all pairs within the radii, none is lost for want of shared keys
    assert union(all_links(rows, within)) == got
    # and against what was planted
    planted = [(i, j) for i in source for j in source if i < j and source[i] == source[j]]
    assert sum(i in got and got[i] == got.get(j) for i, j in planted) >= 0.9 * len(planted)
    assert all(source[i] == source[g] for i, g in got.items())


def test_links_do_not_depend_on_other_rows(spark):
    rows, _ = corpus()
    rng = random.Random(77)
    others = [(10_000 + k, prose(rng, 80)) for k in range(300)]
    alone = {r.doc_id: r.group_id for r in S.groups(documents(spark, rows)).collect()}
    among = {r.doc_id: r.group_id for r in S.groups(documents(spark, rows + others)).collect()}
    assert {i: g for i, g in among.items() if i < 10_000} == alone


@pytest.mark.parametrize("cell", [2, 17])
def test_crowded_shards_lose_no_link(spark, cell):
    """A line that most documents begin with, and one text with many near copies: shards beyond the bound."""
    rng = random.Random(31)
    line, base = prose(rng, 12), prose(rng, 60)
    rows = [(i, f"{line} {prose(rng, 25)}") for i in range(60)]
    rows += [(100 + i, f"{line} {near_copy(rng, base, 0.05)}") for i in range(40)]
    rows += [(200 + i, near_copy(rng, rows[i][1], 0.04)) for i in range(20)]
    docs = documents(spark, rows)
    nodes = S.fingerprints(docs).select(F.col("doc_id").alias("node"), F.col("doc_id").alias("rep"), "a", "b", "c", "d", "keys")
    want = union(all_links(rows))
    assert len(want) > 50
    got = union((r.u, r.v) for r in S.near_edges(nodes, S.RADIUS, S.PAIR_RADIUS, cell=cell).collect())
    assert got == want


def test_group_sizes_and_ids(spark):
    rows, _ = corpus()
    members = defaultdict(set)
    out = S.groups(documents(spark, rows)).collect()
    for r in out:
        members[r.group_id].add(r.doc_id)
    assert all(r.group_size == len(members[r.group_id]) and r.group_id == min(members[r.group_id]) for r in out)
    assert len({r.doc_id for r in out}) == len(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**12 - 1)), max_size=60, unique=True), st.integers(0, 6))
def test_bk_trees_against_a_scan(values, radius):
    values = sorted(values)
    shard = np.array([s for s, _ in values], np.int64)
    x = np.array([(0, v) for _, v in values], np.uint64).reshape(-1, 2)
    forest = S.BKForest(x, shard, radius)
    for k, up in enumerate(forest.parent):
        assert up < k and (up < 0 or shard[up] == shard[k])
    edges = [(int(up), (values[k][1] ^ values[up][1]).bit_count()) for k, up in enumerate(forest.parent) if up >= 0]
    assert len(set(edges)) == len(edges)  # children are keyed by their distance to the parent
    found = [tuple(p) for part in forest.pairs(np.arange(len(x)), np.full(len(x), -1)) for p in part.tolist()]
    want = {(i, j) for j in range(len(x)) for i in range(j) if shard[i] == shard[j] and (values[i][1] ^ values[j][1]).bit_count() <= radius}
    assert set(found) == want and len(found) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 255), st.integers(0, 255), st.integers(0, 3)), max_size=40))
def test_edges_of_shards_connect_as_all_links_do(values):
    shard = np.array([s for s, *_ in values], np.int64)
    fps = np.array([(0, a, 0, c) for _, a, c, _ in values], np.int64).reshape(-1, 4)
    keys = np.array([(k & 1, k >> 1, 7) for *_, k in values], np.int64).reshape(-1, 3)

    def link(i, j):
        return shard[i] == shard[j] and (fps[i, 1] ^ fps[j, 1]).item().bit_count() <= 2 and (fps[i, 3] ^ fps[j, 3]).item().bit_count() <= 3 and (keys[i] == keys[j]).sum() >= 2

    want = union((i, j) for j in range(len(values)) for i in range(j) if link(i, j))
    assert union(S.shard_edges(shard, fps, keys, 2, 3, 2)) == want


def test_fingerprints_by_hand():
    """Against counts of bits word by word."""
    texts = ["One two two three, TWO three!", "x", "  ", None, "é ü ñ é ü", "a " * 700 + "b c d"]
    got = prints(texts)
    assert sorted(got) == [0, 1, 4, 5]
    for k, f in got.items():
        words = re.findall(r"\w+", texts[k].lower())
        bits = [np.unpackbits(np.frombuffer(xxhash.xxh128_digest(w), np.uint8)) for w in dict.fromkeys(words)]
        want = np.packbits(2 * np.sum(bits, axis=0, dtype=int) > len(bits)).tobytes()
        assert f[0] == int.from_bytes(want)
    alone = [prints([t])[0] for t in (texts[0], texts[4])]
    assert all(a[:2] == got[k][:2] and (a[2] == got[k][2]).all() for a, k in zip(alone, (0, 4)))


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)]
    got = {r.u: r.v for r in S.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = {x: r for x, r in union((a, b) for a, b in edges if a != b).items() if x != r}
    assert got == want
    assert S.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_one_of_each_group_stays(spark):
    rows, _ = corpus()
    docs = documents(spark, rows, clashing=True)
    groups = {r.doc_id: r.group_id for r in S.groups(docs).collect()}
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if groups.get(i, i) == i)


def test_awkward_rows(spark):
    docs = documents(spark, [*awkward(2000), (4, "another text under the same id")], clashing=True)
    got = {r.doc_id: (r.group_id, r.group_size) for r in S.groups(docs).collect()}
    assert got == {4: (4, 2), 5: (4, 2)}
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 8, 9] and ids.count(None) == 2
    assert [r.text for r in rows if r.doc_id == 4] == ["another text under the same id"]
    assert S.groups(documents(spark, [])).count() == 0 and S.keep_one(documents(spark, [])).count() == 0


def test_short_texts_are_copies_only_of_equal_ones(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 3)) for i in range(40)] + [(100, "just these words"), (101, "just these words")]
    got = {r.doc_id: r.group_id for r in S.groups(documents(spark, rows)).collect()}
    assert got == {100: 100, 101: 100}


def test_recall_of_short_texts():
    """Pairs at the rim of the radii, of few words: nearly all share enough keys."""
    rng = random.Random(8)
    pairs = []
    while len(pairs) < 300:
        text = prose(rng, rng.randint(10, 50))
        p = prints([text, near_copy(rng, text, 0.1)])
        if within(p[0], p[1]) and p[0][:2] != p[1][:2] and (p[0][0] ^ p[1][0]).bit_count() > 12:
            pairs.append(p)
    assert sum(linked(p[0], p[1]) for p in pairs) >= 0.97 * len(pairs)
