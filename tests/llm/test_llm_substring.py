import random
from collections import defaultdict

import duckdb
import pytest

from hashloom.llm import substring_dedup as B
from llm_data import awkward, documents, prose


def brute(rows, size=B.MIN_WORDS):
    owners = defaultdict(set)
    words = defaultdict(list)
    for i, t in rows:
        if i is not None and t is not None:
            w = t.split()
            words[i].append(w)
            for k in range(len(w) - size + 1):
                owners[tuple(w[k : k + size])].add(i)
    out = set()
    for i, texts in words.items():
        found = {}
        for w in texts:
            for k in range(len(w) - size + 1):
                run = owners[tuple(w[k : k + size])]
                if len(run) > 1:
                    found[k] = min(found.get(k, min(run)), min(run))
        start = end = least = None
        for k in sorted(found):
            if start is not None and k <= end:
                end, least = k + size, min(least, found[k])
            else:
                if start is not None:
                    out.add((i, start, end, least))
                start, end, least = k, k + size, found[k]
        if start is not None:
            out.add((i, start, end, least))
    return out


def spans(spark, rows, **how):
    return {tuple(r) for r in B.repeated_spans(documents(spark, rows, **how)).select("doc_id", "start_word", "end_word", "first_doc_id").collect()}


def corpus(seed):
    """Texts with shared passages of 20 to 200 words, pieces of passages, copies and repeats."""
    rng = random.Random(seed)
    passages = [prose(rng, rng.randint(20, 200)).split() for _ in range(12)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += prose(rng, rng.randint(0, 80)).split()
            p = rng.choice(passages)
            if rng.random() < 0.7:
                a = rng.choice([0, 0, rng.randrange(len(p))])
                words += p[a : rng.choice([len(p), len(p), rng.randrange(len(p)) + 1])]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "same " * 90), (103, "same " * 70), (104, "a b " * 200), (105, "b a " * 150)]
    return rows


@pytest.mark.parametrize("seed", [17, 18])
def test_against_all_runs(spark, seed):
    rows = corpus(seed)
    assert spans(spark, rows) == brute(rows)


def test_against_sql(spark):
    rows = corpus(19)
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(B.ORACLE_SQL).fetchall()
    assert spans(spark, rows) == set(want) == brute(rows)


def test_borders(spark):
    rng = random.Random(20)
    for n in (B.MIN_WORDS - 1, B.MIN_WORDS, B.MIN_WORDS + 1):
        p = prose(rng, n)
        rows = [(1, f"{prose(rng, 5)} {p} {prose(rng, 5)}"), (2, f"{p} {prose(rng, 7)}"), (3, f"{prose(rng, 9)} {p}")]
        got = spans(spark, rows)
        assert got == ({(1, 5, 5 + n, 1), (2, 0, n, 1), (3, 9, 9 + n, 1)} if n >= B.MIN_WORDS else set())


def test_paths_are_unbranched_stretches(spark):
    """Edges of a hand-made graph: a line over two documents, a fork and a circle."""
    edges = [
        # src, dst, doc, at
        (1, 2, 1, 0), (2, 3, 1, 1), (3, 4, 2, 7), (4, 5, 2, 8),  # a line, its second half in document 2
        (5, 6, 1, 20), (5, 7, 1, 30),  # the fork
        (6, 8, 1, 21),
        (20, 21, 3, 0), (21, 22, 3, 1), (22, 20, 3, 2),  # the circle
    ]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, doc bigint, at bigint")
    found = {(r.src, r.dst): (r.path.doc, r.path.at) for r in B.compact(df).collect()}
    path = [found[s, d] for s, d, _, _ in edges]
    assert path[:7] == [(1, 0)] * 4 + [(1, 20), (1, 30), (1, 20)]
    assert {path[k][0] for k in (7, 8, 9)} == {3}


def test_awkward_rows(spark):
    rng = random.Random(21)
    p = prose(rng, 80)
    rows = [*awkward(), (20, f"{p} x"), (20, f"y {p}"), (21, p), (None, p), (22, f"{p}\n{p}")]
    assert spans(spark, rows, clashing=True) == brute(rows)
    assert spans(spark, []) == set()
    # repeated only within one document, or one id
    assert spans(spark, [(1, f"{p} {p}"), (2, "other words")]) == set()
    assert spans(spark, [(1, p), (1, p)]) == set()


def test_many_copies(spark):
    rng = random.Random(22)
    p, q = prose(rng, 90), prose(rng, 70)
    rows = [(i, p) for i in range(300)] + [(i, f"{q} {prose(rng, 3)}") for i in range(300, 500)]
    assert spans(spark, rows) == brute(rows)
