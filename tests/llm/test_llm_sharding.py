import random
from collections import Counter, defaultdict

import numpy as np

from hashloom.llm import sharding as K
from llm_data import awkward, documents, prose


def naive(partials):
    """The method with plain lists: [sums, {row: {its shard: shard of the result}}]."""
    parts = []
    for i, row in enumerate(partials):
        order = sorted(range(len(row)), key=lambda s: (-row[s], s))
        parts.append((i, [row[s] for s in order], [[(i, s)] for s in order]))
    new = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0] - p[1][-1]), p[0]))
        (_, a, x), (_, b, y), *parts = parts
        both = [(m + n, p + q) for m, n, p, q in zip(a, b[::-1], x, y[::-1])]
        order = sorted(range(len(both)), key=lambda s: (-both[s][0], s))
        parts.append((new, [both[s][0] for s in order], [both[s][1] for s in order]))
        new += 1
    _, sums, held = parts[0]
    place = np.empty(np.shape(partials), int)
    for s, owners in enumerate(held):
        for i, own in owners:
            place[i, own] = s
    return sums, place


def test_against_plain_lists():
    rng = random.Random(15)
    for n, k in ((1, 3), (2, 2), (5, 3), (40, 4), (60, 1)):
        partials = np.array([[rng.choice([0, 1, 5, rng.randrange(1000)]) for _ in range(k)] for _ in range(n)], np.int64)
        sums, place = K.difference(partials)
        want, at = naive(partials.tolist())
        assert sums.tolist() == want and (place == at).all()
        total = np.zeros(k, np.int64)
        for i in range(n):
            total[place[i]] += partials[i]
        assert total.tolist() == sums.tolist()


def corpus():
    rng = random.Random(16)
    rows = [(i, prose(rng, int(rng.paretovariate(1.2) * 5) % 2000 + 1)) for i in range(400)]
    return rows + [(1000 + i, rows[i % 7][1]) for i in range(30)]


def weigh(rows, out, shards):
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows)
    text = dict(rows)
    load, where = [0] * shards, defaultdict(set)
    for r in out:
        assert r.bytes == len((text[r.doc_id] or "").encode())
        load[r.shard] += r.bytes
        where[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    return load


def test_shards_are_even_and_texts_stay_together(spark):
    rows = corpus()
    load = weigh(rows, K.shard(documents(spark, rows), shards=8).collect(), 8)
    assert max(load) - min(load) <= 0.002 * sum(load) / 8
    # in a tree of several levels, never further apart than the largest group's bytes
    load = weigh(rows, K.shard(documents(spark, rows), shards=8, fan_in=8).collect(), 8)
    text = Counter(t for _, t in rows)
    assert max(load) - min(load) <= max(n * len(t.encode()) for t, n in text.items())


def test_tighter_than_largest_first(spark):
    rows = corpus()
    load = weigh(rows, K.shard(documents(spark, rows), shards=8).collect(), 8)
    sizes = defaultdict(int)
    for _, t in rows:
        sizes[t] += len(t.encode())
    greedy = [0] * 8
    for n in sorted(sizes.values(), reverse=True):
        greedy[greedy.index(min(greedy))] += n
    assert max(load) - min(load) <= max(greedy) - min(greedy)


def test_awkward_rows(spark):
    rows = awkward()
    out = K.shard(documents(spark, rows, clashing=True), shards=4).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows if i is not None)
    assert {r.bytes for r in out if r.doc_id in (1, 2)} == {0}
    assert len({r.shard for r in out if r.doc_id in (4, 5)}) == 1
    assert K.shard(documents(spark, [])).count() == 0
