import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from hashloom.llm import packing as P
from llm_data import awkward, documents, prose

TIERS = (32, 128, 512)


def naive(lengths, tiers):
    """The same rule with plain lists."""
    tier = [min(t for t in tiers if n <= t) for n in lengths]
    left = set(range(len(lengths)))
    out = [None] * len(lengths)
    for size in sorted(tiers, reverse=True):
        window = 0
        while any(tier[k] == size for k in left):
            used = slot = 0
            for source in sorted((t for t in tiers if t <= size), reverse=True):
                while fit := [k for k in left if tier[k] == source and lengths[k] <= size - used]:
                    k = max(fit, key=lambda k: (lengths[k], -k))
                    out[k] = (size, window, slot, used)
                    used += lengths[k]
                    slot += 1
                    left.discard(k)
            window += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 512), max_size=60))
def test_against_plain_lists(lengths):
    assert P.pack_pieces(lengths, TIERS) == naive(lengths, TIERS)


def corpus():
    rng = random.Random(12)
    return [(i, prose(rng, int(rng.paretovariate(1) * 10) % 3000 + 1)) for i in range(300)]


def check(rows, out, tiers, step_tokens):
    windows = defaultdict(list)
    pieces = defaultdict(list)
    for r in out:
        windows[r.bucket, r.tier, r.window].append(r)
        pieces[r.doc_id].append(r)
    for (_, tier, _), held in windows.items():
        held.sort(key=lambda r: r.slot)
        at = 0
        for n, r in enumerate(held):
            assert (r.slot, r.window_offset) == (n, at)
            at += r.tokens
        assert at <= tier and len({r.step for r in held}) == 1
    for i, t in rows:
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.piece):
            assert r.first_token == at
            at += r.tokens
        assert at == len(t.split()) + 1
    steps = defaultdict(set)
    for r in out:
        steps[r.bucket, r.tier, r.step].add(r.window)
    assert all(len(w) <= max(1, step_tokens // tier) for (_, tier, _), w in steps.items())


def test_each_token_is_packed_once(spark):
    rows = corpus()
    for bucket_tokens in (10**9, 9000):
        out = P.pack(documents(spark, rows), tiers=TIERS, step_tokens=2048, bucket_tokens=bucket_tokens).collect()
        check(rows, out, TIERS, 2048)
    assert len({r.bucket for r in out}) > 1


def test_windows_are_full_and_steps_even(spark):
    out = P.pack(documents(spark, corpus()), tiers=TIERS, step_tokens=2048).collect()
    fill = defaultdict(int)
    for r in out:
        fill[r.tier, r.window, r.step] += r.tokens
    assert sum(fill.values()) >= 0.95 * sum(t for t, _, _ in fill)
    by_step = defaultdict(list)
    for (tier, _, step), n in fill.items():
        by_step[tier, step].append(n)
    for tier in TIERS:
        full = [sum(x) for (t, _), x in by_step.items() if t == tier and len(x) == 2048 // tier]
        assert not full or max(full) - min(full) <= tier


def test_long_windows_take_short_documents(spark):
    rows = [(1, "w " * 400), (2, "w " * 100), (3, "w " * 9)]
    out = {r.doc_id: r for r in P.pack(documents(spark, rows), tiers=TIERS).collect()}
    assert [(out[i].tier, out[i].window, out[i].slot) for i in (1, 2, 3)] == [(512, 0, 0), (512, 0, 1), (512, 0, 2)]


def test_awkward_rows(spark):
    rows = awkward()
    out = P.pack(documents(spark, rows, clashing=True), tiers=TIERS).collect()
    assert {r.doc_id for r in out} == {4, 5, 6, 7, 8, 9}
    assert sum(r.tokens for r in out if r.doc_id == 4) == 2 * 61
    assert sum(r.tokens for r in out if r.doc_id == 7) == 30_001
    assert P.pack(documents(spark, [])).count() == 0


def test_with_a_public_tokenizer(spark):
    import glob

    import pytest
    from tokenizers import Tokenizer

    paths = sorted(glob.glob("/opt/tokenizers/byte_bpe_50k.json"))
    if not paths:
        pytest.skip("no tokenizer files")
    rows = corpus()[:20]
    tok = Tokenizer.from_file(paths[0])
    tok.encode_special_tokens = True
    got = {r.doc_id: r.tokens for r in P.token_counts(documents(spark, rows), paths[0]).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
