import random

import zstandard

from hashloom.llm import langid
from llm_data import SYLLABLES, awkward, documents, prose


def corpus(n=240):
    rng = random.Random(2)
    langs = list(SYLLABLES)
    return [(i, prose(rng, rng.randint(8, 150), langs[i % 3]), langs[i % 3]) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = corpus()
    model = langid.train(documents(spark, rows[:120]), per_language=30)
    got = langid.identify(documents(spark, rows[120:]), model).collect()
    assert len(got) == 120
    assert sum(r.predicted == r.lang and r.accepted for r in got) >= 116


def test_against_plain_compression(spark):
    rows = corpus(60)
    model = langid.train(documents(spark, rows), per_language=10)
    for r in langid.identify(documents(spark, rows), model).collect():
        data = langid.letters({i: t for i, t, _ in rows}[r.doc_id])
        sizes = []
        for lang, content in model.content:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=langid.LEVEL)
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(c.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK)), lang))
        sizes.sort()
        assert r.predicted == sizes[0][1]
        assert abs(r.margin - (sizes[1][0] - sizes[0][0]) / sizes[0][0]) < 1e-12
        assert r.accepted == (r.margin >= model.min_margin)


def test_narrow_margins_are_rejected(spark):
    model = langid.train(documents(spark, corpus()), per_language=30)
    rng = random.Random(3)
    mixed = "".join(rng.choice("qxzwjk") for _ in range(12))
    (r,) = langid.identify(documents(spark, [(1, mixed)]), model).collect()
    assert not r.accepted


def test_awkward_rows(spark):
    model = langid.train(documents(spark, corpus()), per_language=20)
    got = langid.identify(documents(spark, [*awkward(), (11, "words", None)], clashing=True), model).collect()
    assert len(got) == len(awkward()) + 1
    assert all(r.predicted is None and not r.accepted for r in got if r.doc_id in (1, 2, 3, 6))
    assert langid.identify(documents(spark, []), model).count() == 0
    empty = langid.train(documents(spark, []))
    assert [r.predicted for r in langid.identify(documents(spark, [(1, "words")]), empty).collect()] == [None]


def test_stray_labels_and_too_many_languages(spark):
    rows = corpus()
    strays = [(1000 + k, "some words of a stray label", f"x{k}") for k in range(500)]
    model = langid.train(documents(spark, rows + strays))
    assert [lang for lang, _ in model.content] == sorted({lang for *_, lang in rows})
    assert len(langid.identify(documents(spark, rows[:5] + strays), model).collect()) == 505
    assert len(langid.train(documents(spark, rows), max_languages=2).content) == 2
