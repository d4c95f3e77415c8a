import math
import random
from collections import Counter

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from hashloom.llm import decontaminate as D
from llm_data import awkward, documents, prose


def items(rng, n=40):
    return [(k, ". ".join(prose(rng, rng.randint(6, 14)).capitalize() for _ in range(rng.randint(2, 5))) + ".") for k in range(n)]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def shares_of(rows):
    """{(item_id, text): {term: share}} by BM25 as it is written in books, words as text."""
    pairs = {}
    for k, t in rows:
        w = D.words_of(t)
        if len(w) > 1:
            pairs[k, t] = Counter(zip(w, w[1:]))
    df = Counter(p for tf in pairs.values() for p in tf)
    mean = sum(sum(tf.values()) for tf in pairs.values()) / len(pairs)
    out = {}
    for key, tf in pairs.items():
        norm = D.K1 * (1 - D.B + D.B * sum(tf.values()) / mean)
        raw = {p: math.log(1 + (len(pairs) - df[p] + 0.5) / (df[p] + 0.5)) * c * (D.K1 + 1) / (c + norm) for p, c in tf.items()}
        out[key] = {p: v / sum(raw.values()) for p, v in raw.items()}
    return out


def corpus():
    rng = random.Random(7)
    tests = items(rng)
    rows, planted = [], set()
    for i in range(120):
        words = prose(rng, rng.randint(20, 900)).split()
        if i % 3 == 0:
            k = rng.randrange(len(tests))
            at = rng.randrange(len(words))
            words[at:at] = tests[k][1].split()
            planted.add((i, k))
        elif i % 3 == 1:  # only part of an item
            part = tests[rng.randrange(len(tests))][1].split()
            words[0:0] = part[: len(part) // 5]
        rows.append((i, " ".join(words)))
    return tests, rows, planted


def brute(rows, tests, theta=D.THETA, overlap=D.OVERLAP):
    """Every passage against every item, term by term, in words."""
    shares = shares_of(tests)
    width = max(D.PASSAGE_WORDS, 2 * max(len(D.words_of(t)) for _, t in tests))
    sides = {}
    for key in shares:
        q, a = D.question_and_answer(key[1])
        w = list(zip(q + a, (q + a)[1:]))
        sides[key] = set(w[: max(1, len(q) - 1)]), set(w[len(q) - 1 if len(q) > 1 else 0 :])
    out = {}
    for i, text in rows:
        w = D.words_of(text or "")
        for s in range(0, max(1, len(w)), width // 2):
            p = w[s : s + width]
            inside = set(zip(p, p[1:]))
            for key, share in shares.items():
                q, a = sides[key]
                score = sum(v for t, v in share.items() if t in inside)
                if score >= theta - 1e-9 and len(q & inside) >= overlap * len(q) and len(a & inside) >= overlap * len(a):
                    if (i, key[0]) not in out or score > out[i, key[0]][0] + 1e-12:
                        out[i, key[0]] = (score, len(q & inside) / len(q), len(a & inside) / len(a), s)
    return out


def test_against_every_passage_and_item(spark):
    tests, rows, planted = corpus()
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap, r.first_word) for r in D.find_leaks(documents(spark, rows), bench(spark, tests)).collect()}
    want = brute(rows, tests)
    assert set(got) == set(want) == planted
    for k, x in got.items():
        assert all(abs(a - b) < 1e-9 for a, b in zip(x, want[k]))


def test_several_indexes_find_the_same(spark):
    tests, rows, planted = corpus()
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(documents(spark, rows), bench(spark, tests), limit=4000, items_a_shard=7).collect()}
    assert got == planted


def index_of(rows):
    cols = [(k, 0, t[0], random.Random(f"{k} {t[0]}").random(), t[2], t[3]) for k, text in rows for t in D.item_terms(text)]
    return D.build_index(*(np.array(c) for c in zip(*cols)))


def test_wand_against_full_scores():
    rng = random.Random(8)
    # many items share few words, so that postings span several blocks
    tests = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 12)))) for k in range(150)]
    index = index_of(tests)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.keys)), rng.randint(0, min(30, len(index.keys)))))
        theta = rng.choice([0.1, 0.3, 0.5, 0.8])
        full = Counter()
        for t in terms:
            for n, s in zip(*index.postings[t]):
                full[n] += s
        assert {n for n, _ in D.block_max_wand(index, terms, theta)} == {n for n, s in full.items() if s >= theta - 1e-9}


LETTERS = st.text(st.characters(codec="utf-8"), min_size=1, max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(LETTERS, min_size=2, max_size=30), st.sampled_from([str, str.upper, str.lower, str.title]))
@example(["ΟΔΟΣ", "ΣΟΦΟΣ", "ΛΟΓΟΣ"], str)
@example(["İSTANBUL", "ISPARTA", "DİYARBAKIR"], str)
@example(["Straße", "ﬁnden", "Ǆ"], str)
def test_every_item_equals_its_own_copy(words, changed):
    """In any script; a copy in other case too, where case is all that changes."""
    text = " ".join(words)
    rows = D.item_terms(text)
    copy = changed(text)
    if D.words_of(copy) != D.words_of(text):
        copy = text
    flat, offsets = D.tokens(["other words here", copy, None])
    bounds = D.Bounds(np.array([r[0] for r in rows], np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), 1 / max(1, len(rows))))
    found = list(D.passages(flat, offsets, bounds, 128, 0.999))
    if not rows:
        assert found == []
        return
    index = D.build_index(*(np.array(c) for c in zip(*[(5, 0, r[0], 1 / len(rows), r[2], r[3]) for r in rows])))
    assert {(r, x[0], round(x[2], 9), x[3], x[4]) for r, _, held, _ in found for x in D.leaks_in(index, held, 0.999, 1.0)} == {(1, 5, 1.0, 1.0, 1.0)}


def test_passages_against_each_window():
    """Every window of every text, shard by shard, by sets."""
    rng = random.Random(3)
    words = [prose(rng, 1) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 7, 8, 9, 15, 16, 17, 40, 90]))) for _ in range(60)] + [None, ""]
    flat, offsets = D.tokens(texts)
    terms = np.unique(D.pair_hashes(flat))
    rows = [(int(t), s, rng.random()) for t in rng.sample(terms.tolist(), len(terms) // 2) for s in rng.sample(range(3), rng.randint(1, 3))]
    for width, theta in ((8, 1.5), (16, 3.0), (16, 0.0)):
        got = sorted((r, s, tuple(h), k) for r, s, h, k in D.passages(flat, offsets, D.Bounds(*(np.array(c) for c in zip(*rows))), width, theta))
        want = []
        for r, text in enumerate(texts):
            h = D.pair_hashes(D.tokens([text])[0]).tolist() if text and " " in text else []
            for s in range(0, len(h) + 1, width // 2):
                inside = set(h[s : s + width - 1])
                for k in range(3):
                    own = [m for t, x, m in rows if x == k and t in inside]
                    if own and sum(own) >= theta:
                        want.append((r, s, tuple(sorted(inside)), k))
        assert got == sorted(want)


def test_other_scripts_end_to_end(spark):
    tests = [(1, "ΠΟΙΟΣ ΕΙΝΑΙ Ο ΜΕΓΑΛΟΣ ΠΟΤΑΜΟΣ ΤΗΣ ΧΩΡΑΣ; Ο ΝΕΙΛΟΣ ΕΙΝΑΙ Ο ΜΕΓΑΛΟΣ ΠΟΤΑΜΟΣ."), (2, "İSTANBUL HANGİ İLDİR VE NERESİDİR? ÇOK BÜYÜK BİR ŞEHİRDİR İSTANBUL.")]
    rows = [(10, tests[0][1]), (11, f"x y {tests[1][1]} z"), (12, tests[0][1].lower()), (13, tests[0][1].casefold())]
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(documents(spark, rows), bench(spark, tests)).collect()}
    assert got == {(10, 1), (11, 2), (12, 1), (13, 1)}


def test_clean_documents_stay(spark):
    tests, rows, planted = corpus()
    docs = documents(spark, rows, clashing=True)
    kept = D.keep_clean(docs, bench(spark, tests))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in planted}


def test_awkward_rows(spark):
    rng = random.Random(9)
    tests = items(rng, 5)
    leak = tests[2][1]
    tests += [(None, leak), (7, None), (8, ""), (9, "word"), (2, leak)]
    docs = documents(spark, [*awkward(), (None, f"x {leak} y"), (20, leak), (20, leak), (21, leak.upper())], clashing=True)
    got = sorted(((r.doc_id, r.item_id) for r in D.find_leaks(docs, bench(spark, tests)).collect()), key=str)
    assert got == sorted([(20, 2), (20, 2), (21, 2), (None, 2)], key=str)
    kept = D.keep_clean(docs, bench(spark, tests))
    assert {r.doc_id for r in kept.collect()} == {None, *range(1, 10)}
    assert D.find_leaks(documents(spark, []), bench(spark, tests)).count() == 0
    assert D.find_leaks(docs, bench(spark, [])).count() == 0


def test_question_and_answer():
    q, a = D.question_and_answer("What is the name of it? It is the long red one. Yes.")
    assert (q, a) == ("what is the name of it".split(), "it is the long red one yes".split())
    q, a = D.question_and_answer("one two three four five six seven eight")
    assert (q, a) == ("one two three four five six".split(), "seven eight".split())
