import random

import zstandard

from hashloom.llm import quality
from llm_data import CLASHING, awkward, documents, junk, prose


def corpus():
    rng = random.Random(1)
    return [(i, prose(rng, rng.randint(5, 200)) if i % 2 else junk(rng, rng.randint(5, 200))) for i in range(600)]


def labels(spark, rows):
    return spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_probabilities(spark):
    rows = corpus()
    model = quality.train(documents(spark, rows), labels(spark, rows[:300]), per_class=100)
    got = {r.doc_id: r for r in quality.score(documents(spark, rows[300:]), model).collect()}
    assert len(got) == 300
    assert sum(r.keep == bool(i % 2) for i, r in got.items()) >= 294
    # calibration: the mean probability is near the share of good texts
    assert abs(sum(r.p_good for r in got.values()) / 300 - 0.5) < 0.05


def test_probabilities_at_an_uneven_mix(spark):
    """Six in seven labels are good, and the probabilities say so, though the sample is even."""
    rng = random.Random(3)
    rows = [(i, junk(rng, rng.randint(4, 40)) if i % 7 == 0 else f"{prose(rng, rng.randint(1, 30))} {junk(rng, rng.randint(0, 6))}") for i in range(1400)]
    marks = spark.createDataFrame([(i, int(i % 7 != 0), 0) for i, _ in rows[:700]], "doc_id bigint, quality int, toxic int")
    model = quality.train(documents(spark, rows), marks, per_class=100)
    p = [r.p_good for r in quality.score(documents(spark, rows[700:]), model).collect()]
    assert abs(sum(p) / len(p) - 6 / 7) < 0.04


def test_sizes_against_plain_compression(spark):
    rows = corpus()[:80]
    model = quality.fit_model({c: [r for r in rows if r[0] % 2 == c] for c in (0, 1)}, dict_bytes=4096)

    def size(text, data, trained):
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        total, raw = 0, text.encode()
        for i in range(0, len(raw), quality.BLOCK):
            d = zstandard.ZstdCompressionDict(data, dict_type=kind)
            d.precompute_compress(level=quality.LEVEL)
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            total += len(c.compress(raw[i : i + quality.BLOCK]))
        return total

    for r in quality.score(documents(spark, rows), model).collect():
        text = dict(rows)[r.doc_id]
        good, bad = size(text, model.good, model.good_trained), size(text, model.bad, model.bad_trained)
        assert abs(r.diff - (bad - good) / (bad + good + quality.PRIOR)) < 1e-12


def test_awkward_rows(spark):
    rows = corpus()
    model = quality.train(documents(spark, rows), labels(spark, rows), per_class=50)
    docs = documents(spark, awkward(), clashing=True)
    got = quality.score(docs, model).collect()
    assert len(got) == len(awkward())
    assert all(not r.keep and r.p_good is None for r in got if r.doc_id in (1, 2, 3))
    assert len({(r.diff, r.p_good) for r in got if r.doc_id in (4, 5)}) == 1
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and set(CLASHING) < set(kept.columns)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.keep}
    assert quality.score(documents(spark, []), model).count() == 0


def test_training_without_rows_or_with_one_class(spark):
    none = quality.train(documents(spark, []), labels(spark, []))
    assert quality.score(documents(spark, [(1, "a few words")]), none).count() == 1
    rows = [r for r in corpus() if r[0] % 2]
    one = quality.train(documents(spark, rows), labels(spark, rows), per_class=40)
    assert quality.score(documents(spark, rows[:5]), one).count() == 5


def test_contradicting_and_null_labels_are_left_out(spark):
    docs = documents(spark, [(1, "good words"), (2, "bad words"), (3, "unclear")])
    marks = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.sample_texts(docs, marks, "quality", [0, 1], 10, 1) == {0: [(2, "bad words")], 1: [(1, "good words")]}
