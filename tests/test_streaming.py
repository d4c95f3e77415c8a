"""Streams give what batches give."""

from pyspark.sql import functions as F

from corpus import LINES
from hashloom.config import Config
from hashloom.plans import Embedder
from hashloom.sources.readers import from_table
from hashloom.sqlfuncs import register
from hashloom.streaming import embed_stream, line_stream
from hashloom.streaming.embed_stream import dictionary_stream, merged_dictionary


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_bytes(b"\n".join(LINES[4 * k : 4 * k + 4]) + b"\n")
    df = spark.createDataFrame([(k, x.decode()) for k, x in enumerate(LINES)], "row_id bigint, data string")
    for engine in ("arrow", "catalyst"):
        e = Embedder(Config(vect_norm="l2"), engine)
        out, state = str(tmp_path / f"out-{engine}"), str(tmp_path / f"state-{engine}")
        embed_stream(line_stream(spark, str(tmp_path / "in"), files_per_trigger=1), e, out, state).awaitTermination()
        got = sorted(map(str, spark.read.parquet(out).select("vec").collect()))
        assert got == sorted(map(str, e.transform(df).select("vec").collect()))
    weights = Embedder(Config(vect_embed="tfidf")).fit(df)
    embed_stream(line_stream(spark, str(tmp_path / "in")), weights, str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 8


def test_dictionary_stream(spark, tmp_path):
    df = spark.createDataFrame([(k, x.decode()) for k, x in enumerate(LINES)], "row_id bigint, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    e = Embedder(Config())
    dictionary_stream(from_table(stream, "row_id", "text"), e, str(tmp_path / "d"), str(tmp_path / "s")).awaitTermination()
    got = {(r.dim, bytes(r.feat)) for r in merged_dictionary(spark, str(tmp_path / "d")).collect()}
    assert got == {(r.dim, bytes(r.feat)) for r in e.dictionary(from_table(df, "row_id", "text")).collect()}


def test_sql_functions(spark):
    register(spark, Config())
    r = spark.sql("SELECT hl_embed('a b a') v, hl_hash('a') h, hl_dot(hl_embed('a b a'), hl_embed('a')) d, hl_decode('a%20b') t, hl_hash(CAST(NULL AS STRING)) n").first()
    assert sorted(e["val"] for e in r.v) == [1.0, 2.0] and r.d == 2.0 and bytes(r.t) == b"a b" and r.n is None
    assert r.h & 4194303 in [e["dim"] for e in r.v]


def test_plans_stay_row_local(spark):
    df = spark.createDataFrame([(0, "a b")], "row_id bigint, data string")
    for engine in ("arrow", "catalyst"):
        plan = Embedder(Config(vect_norm="l2", dim_reduce="bloom"), engine).transform(df)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    long = Embedder(Config(), "catalyst").transform(df).select(F.explode("vec"))
    assert "Python" not in long._jdf.queryExecution().executedPlan().toString()
