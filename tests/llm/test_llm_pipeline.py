import random

import pytest

import corpus_pipeline
from hashloom.llm import decontaminate, packing, pii, quality, simhash_dedup
from hashloom.llm.queries import QUERIES
from llm_data import documents, junk, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(23)
    item = ". ".join(prose(rng, 9).capitalize() for _ in range(4)) + "."
    rows = []
    for i in range(160):
        if i % 4 == 3:
            rows.append((i, junk(rng, rng.randint(30, 150))))
        elif i % 10 == 4:
            rows.append((i, f"{prose(rng, 80)} {item} {prose(rng, 20)}"))
        elif i % 10 == 6:
            rows.append((i, f"{prose(rng, 80)} write to {prose(rng, 1)}@mail.example.org now"))
        else:
            rows.append((i, prose(rng, rng.randint(60, 300))))
    rows += [(200 + k, rows[k][1]) for k in (0, 1, 2)] + [(210, rows[0][1] + " more"), (None, None), (300, ""), (301, None)]
    path = tmp_path_factory.mktemp("tables")
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 3), 0) for i, _ in rows[:120]], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, "https://e.example/", "<p>x</p>")], "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path), rows


def test_stage_by_stage(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    good = stages["quality classifier"](spark, docs, path).cache()
    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    s = quality.Scorer(model)
    want = sorted(i for i, t in rows if t and t.strip() and s.probability(t)[1] >= model.threshold)
    assert sorted(r.doc_id for r in good.collect()) == want
    assert sum(i % 4 == 3 for i in want if i < 160) <= 2 and sum(i % 4 != 3 for i in want if i < 160) >= 118

    one = stages["SimHash near-dedup"](spark, good, path).cache()
    groups = {r.doc_id: r.group_id for r in simhash_dedup.groups(good).collect()}
    left = sorted(r.doc_id for r in one.collect())
    assert left == sorted(i for i in want if groups.get(i, i) == i) and not {200, 201, 202, 210} & set(left)

    clean = stages["benchmark decontamination"](spark, one, path).cache()
    leaked = {r.doc_id for r in decontaminate.find_leaks(one, spark.read.parquet(f"{path}/benchmark.parquet")).collect()}
    assert leaked == {i for i in left if i % 10 == 4 and i % 4 != 3 and i < 160}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(left) - leaked)

    masked = stages["PII"](spark, clean, path).cache()
    model = pii.train()
    assert {r.doc_id: r.text for r in masked.collect()} == {r.doc_id: pii.redacted(r.text, model) for r in clean.collect()}
    assert not [r for r in masked.collect() if "@" in r.text]

    plan = stages["packing"](spark, masked, path).collect()
    assert {r.doc_id for r in plan} == {r.doc_id for r in masked.collect()}
    assert sum(r.tokens for r in plan) == sum(len(r.text.split()) + 1 for r in masked.collect())
    for df in (good, one, clean, masked):
        assert df.columns == docs.columns
        df.unpersist()

    run = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, plan))


def test_stages_on_an_empty_table(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_queries_of_all_ten(spark, folder):
    path, rows = folder
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    for name, q in QUERIES.items():
        out = q(spark, path)
        assert len(set(out.columns)) == len(out.columns)
        out.count()
