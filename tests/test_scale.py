"""What larger tables need: joins without rows of entries, bounded batches, spread rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hashloom.config import Config
from hashloom.functions import vectors as V
from hashloom.functions.hashing import hash_bytes, hash_slices
from hashloom.operators import longform as L
from hashloom.operators.kernel import Kernel, pack_vectors, slices
from hashloom.plans import queries as Q
from hashloom.plans.embedder import Embedder
from hashloom.sinks.writers import _batches_of_lines


def _texts(spark, n=300):
    words = np.random.default_rng(7).integers(0, 400, (n, 12))
    rows = [(k % 290, " ".join(f"w{x}" for x in w) if k % 50 else ["", "  ", None][k // 50 % 3]) for k, w in enumerate(words)]
    return spark.createDataFrame(rows, "row_id bigint, data string").repartition(3)


def _sorted(df):
    return sorted(((r.row_id, sorted((e.dim, round(e.val, 5)) for e in r.vec)) for r in df.collect()), key=repr)


def test_joined_tfidf_is_broadcast_tfidf_without_rows_of_entries(spark):
    df = _texts(spark)
    for c in (Config(vect_embed="tfidf"), Config(vect_embed="tfidf", vect_norm="l2", thres_low=0.1, hash_bits=64), Config(vect_embed="tfidf", dim_reduce="simhash")):
        for engine in ("arrow", "catalyst"):
            e = Embedder(c, engine).fit(df)
            joined = e._joined_tfidf(df, "data", "vec", ["row_id"])
            assert _sorted(joined) == _sorted(Embedder(c, "arrow", idf=e.idf).transform(df))
    assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 300


def test_round6_is_round(spark):
    x = np.random.default_rng(1).normal(0, 3, 20000).astype(np.float32).tolist() + [0.0078125, -0.0078125, 0.0, -0.0, 1e30, float("inf"), -1e-9, None]
    df = spark.createDataFrame([(v,) for v in x], "x float")
    both = df.select(Q.round6(F.col("x")).alias("a"), F.round(F.col("x").cast("double"), 6).alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_catalyst_vectors_are_worked_out_once_and_on_all_cores(spark, tmp_path):
    spark.range(500).select(F.col("id").alias("p_partkey"), F.lit("blue green blue").alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("byte3_count_catalyst", "simhash_catalyst"):
        df = Q.QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "size(" not in plan.split("Repartition")[1] and plan.count("Filter") == 1
        assert df.select(F.spark_partition_id()).distinct().count() >= 4
        assert df.groupBy("row_id").agg(F.sum("val")).count() == 500


def _peak(work) -> float:
    tracemalloc.start()
    try:
        for _ in work():
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_workers_memory_does_not_follow_the_batch():
    from hashloom.operators.kernel import distinct_grams

    words = np.random.default_rng(3).integers(0, 50000, (4000, 400))
    batch = pa.RecordBatch.from_pydict({"id": np.arange(4000), "data": pa.array([" ".join(map(str, w)).encode() for w in words], pa.binary())})
    kernel = Kernel(Config())
    assert _peak(lambda: (kernel.vectors(b.column(1).to_pylist()) for b in slices([batch]))) < 60
    assert _peak(lambda: (distinct_grams(kernel, b.column(0), b.column(1)) for b in slices([batch]))) < 60


def test_lines_are_made_in_small_batches():
    n, m = 2000, 300
    vec = pack_vectors(np.repeat(np.arange(n), m), np.tile(np.arange(m, dtype=np.uint64), n), np.ones(n * m, np.float32), n)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.nulls(n, pa.string()), pa.nulls(n, pa.float32()), vec], names=["row_id", "src", "label", "vec"])
    made = list(_batches_of_lines([batch], "libsvm"))
    assert max(b.nbytes for b in made) < 2 << 20 and sum(b.num_rows for b in made) == n
    assert pa.Table.from_batches(made).column("value")[n - 1].as_py() == "0 " + "".join(f"{d + 1}:1 " for d in range(m))


def test_vector_queries_embed_in_one_pass(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, " b"), (3, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = lambda name: Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan("vec_add").count("MapInArrow") == 1
    for name in ("vec_binarize", "vec_mul", "vec_log2", "vec_invert"):
        assert plan(name).count("MapInArrow") == 1 and "regexp_extract" not in plan(name)
    assert sorted(r.val for r in Q.vec_add(spark, str(tmp_path)).collect()) == [1, 2, 3]


@pytest.mark.parametrize("options", [{}, {"ngram_len": 2, "ngram_blend": True}, {"ngram_pos": True, "pos_shift": 1}, {"granularity": "bytes", "ngram_len": 3, "hash_algorithm": "md5"}])
def test_dictionary_is_that_of_all_ngrams(spark, options):
    e = Embedder(Config(hash_bits=6, chunk_size=7, **options))
    df = _texts(spark).filter("row_id >= 10")
    named = e.named(df)
    for scope in (None, ["chunk"]):
        got = e.dictionary(df, chunked=scope is not None)
        want = L.dictionary(named.withColumn("chunk", F.expr("row_id div 7")), scope)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert "SortAggregate" not in spark_plan(e.dictionary(df).select("dim", "insertions"))


def spark_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_without_an_id_come_last_in_a_dictionary(spark):
    rows = [(None, "x"), (5, "y"), (-3, "z"), (2, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, data string").coalesce(1)
    got = {r.chunk: (bytes(r.feat), r.insertions, r.collisions) for r in Embedder(Config(hash_bits=1, chunk_size=100)).dictionary(df, chunked=True).collect() if r.dim == 0} | {}
    whole = Embedder(Config(hash_bits=1)).dictionary(df).collect()
    assert sum(r.insertions for r in whole) == 4 and None in {r.chunk for r in Embedder(Config(hash_bits=1, chunk_size=100)).dictionary(df, chunked=True).collect()}
    assert all(n >= c for _, n, c in got.values())
    assert bytes(min(whole, key=lambda r: bytes(r.feat) != b"z").feat) == b"z"


def test_entries_are_rows_without_packed_vectors(spark, tmp_path):
    texts = [(1, "a b a"), (2, " b"), (3, ""), (4, None), (5, "c a\nb b")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("vec_add", "tok_count"):
        plan = Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and plan.count("MapInArrow") == 1
    df = spark.createDataFrame([(k, t, (t or "").split(" ")[-1]) for k, t in texts], "row_id bigint, a string, b string")
    for c in (Config(), Config(vect_sign=True), Config(hash_bits=64), Config(vect_norm="l2"), Config(dim_reduce="bloom")):
        vecs = Embedder(c).transform_all(df, {"a": "a", "b": "b"}, ["row_id"])
        want = L.explode_vectors(vecs.select("row_id", V.add(F.col("a"), F.col("b")).alias("vec")))
        for engine in ("arrow", "catalyst"):
            got = Embedder(c, engine).entries(df, ["a", "b"], ["row_id"])
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_counts_sorted_as_one_number_are_counts():
    rows = np.sort(np.random.default_rng(5).integers(0, 40, 3000))
    dims = np.random.default_rng(6).integers(0, 50, 3000).astype(np.uint64) << np.uint64(12)
    for bits in (18, 22, 40, 52):
        kernel = Kernel(Config(hash_bits=bits))
        order = np.lexsort((dims, rows))
        for got, want in zip(kernel._counted(rows, dims), kernel._sum(rows[order], dims[order], np.ones(3000, np.float32))):
            assert got.dtype == want.dtype and got.tolist() == want.tolist()


def test_slices_of_any_length_are_hashed():
    buffer = np.random.default_rng(8).integers(0, 256, 300000).astype(np.uint8)
    start, length = np.array([7, 0, 5, 9, 1, 2, 3]), np.array([65535, 0, 200000, 65536, 3, 200000, 70000])
    got = hash_slices(buffer, start, length).tolist()
    assert got == [hash_bytes(buffer[s : s + n].tobytes()) for s, n in zip(start.tolist(), length.tolist())]


def test_sums_are_added_up_before_they_move(spark):
    from hashloom.operators import blocks as B

    texts = [" ".join(f"w{x}" for x in w) for w in np.random.default_rng(9).integers(0, 300, (900, 20))] + ["", None]
    batches = [pa.RecordBatch.from_pydict({"data": pa.array(texts[i : i + 100], pa.binary())}) for i in range(0, 902, 100)]
    df = spark.createDataFrame([(t,) for t in texts], "data string")
    for c in (Config(), Config(vect_norm="l2"), Config(vect_sign=True), Config(hash_bits=64), Config(thres_low=9.0)):
        e = Embedder(c)
        want = {r.dim: r.val for r in L.sum_vectors(L.explode_vectors(e.transform(df), keys=[])).collect()}
        for most in (1, 400, 1 << 18):
            made, got = list(B.sums(e._kernel(), most)(iter(batches))), {}
            for m in made:
                for d, v in zip(*(x.to_pylist() for x in m.columns)):
                    got[d] = got.get(d, 0) + v
            assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-4 for d in got)
        assert len(made) == bool(want) and sum(m.num_rows for m in made) == len(want)
        for engine in ("arrow", "catalyst"):
            assert {r.dim: round(r.val, 3) for r in Embedder(c, engine).total(df).collect()} == {d: round(v, 3) for d, v in want.items()}


def test_a_dictionarys_first_ngrams_need_no_order_of_rows(spark):
    from hashloom.operators.kernel import distinct_grams

    for ids in ([5, 5, 2, None, 2, None], [1, 2, 3, 4, 5, 6], [-3, -9, 0, None, 7, 1 << 45]):
        data = ["a b c a", "c d a", "b", "e a e", "d b", ""]
        for c in (Config(), Config(ngram_len=2, ngram_blend=True)):
            for size in (0, 4):
                kernel, want = Kernel(c), {}
                named = kernel.named([d.encode() for d in data])
                seen: dict = {}
                for row, dim, feat in named:
                    at = seen[row] = seen.get(row, -1) + 1
                    i = ids[row]
                    place = (1 << 80) + at if i is None else (i << 40) + at
                    key = (None if i is None or not size else i // size, i is None and bool(size), dim, feat)
                    first, n = want.get(key, (place, 0))
                    want[key] = (min(first, place), n + 1)
                got = distinct_grams(kernel, pa.array(ids, pa.int64()), pa.array([d.encode() for d in data], pa.binary()), size)
                assert sorted(((r["chunk"], r["dim"], r["feat"], int(r["first"]) % (1 << 64), r["n"]) for r in got.to_pylist()), key=repr) == sorted(
                    ((k[0], k[2], k[3], v[0] % (1 << 64), v[1]) for k, v in want.items()), key=repr
                )
