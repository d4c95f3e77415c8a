"""Published results, by both engines."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpus import CASES, LINES
from hashloom.config import Config
from hashloom.operators.kernel import Kernel
from hashloom.plans import Embedder
from hashloom.sinks import formats


def digest(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:24]


def shown(vectors):
    return [formats.text_line(formats.pairs(v), f"line{k}") for k, v in enumerate(vectors)]


@pytest.mark.parametrize("options,expected", CASES)
def test_kernel(options, expected):
    assert digest(shown(Kernel(Config(**options)).vectors(list(LINES)).to_pylist())) == expected


@pytest.mark.parametrize("engine", ["arrow", "catalyst"])
def test_engines(spark, engine):
    df = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(LINES)], "row_id bigint, data binary").coalesce(1)
    # one plan for all cases would be large; each is small
    for options, expected in CASES:
        rows = Embedder(Config(**options), engine).transform(df).orderBy("row_id").collect()
        assert digest(shown([r["vec"] for r in rows])) == expected, options


@pytest.mark.parametrize(
    "text,delim,n,dims",
    [
        (" a:a a:a a:a a:a ", " ", 1, 1),
        (" a:a a:b a:c a:d ", " ", 1, 4),
        (" a:a b:c a:a b:c ", " :", 1, 3),
        (" a:a a:b a:c a:d ", " :", 1, 4),
        (" a:a a:a a:a a:a ", " ", 2, 1),
        (" a:a a:b a:c a:d ", " ", 2, 3),
        (" a:a a:a a:a a:a ", " :", 2, 1),
        (" a:a a:a a:a a:a ", "", 1, 3),
        (" a:a a:b a:c a:d ", "", 1, 6),
        (" a:a a:a a:a a:a ", "", 2, 4),
    ],
)
def test_dimensions(text, delim, n, dims):
    c = Config(ngram_len=n, token_delim=delim, granularity="tokens" if delim else "bytes")
    assert len(Kernel(c).vectors([text.encode()])[0]) == dims


@pytest.mark.parametrize(
    "text,n,options,dims",
    [
        ("a b c b a", 3, {}, 3),
        ("a b c b a", 3, {"ngram_sort": True}, 2),
        ("a b c b a", 2, {}, 4),
        ("a b c b a", 2, {"ngram_sort": True}, 2),
        ("a b c d e", 3, {"ngram_blend": True}, 12),
        ("a b c d e", 2, {"ngram_blend": True}, 9),
        ("b b b b b", 3, {}, 1),
        ("b b b b b", 3, {"ngram_pos": True}, 3),
        ("b b b b b", 2, {"ngram_pos": True}, 4),
    ],
)
def test_variants(text, n, options, dims):
    assert len(Kernel(Config(ngram_len=n, token_delim=" ", **options)).vectors([text.encode()])[0]) == dims


def test_embedding_invariants(spark):
    rows = [(k, x) for k, x in enumerate(["a a ", "a b b", "b b c", "b c d d"])]
    df = spark.createDataFrame(rows, "row_id bigint, data string")
    base = Config(token_delim=" .,%0a%0d")
    values = lambda c, e=None: [[x["val"] for x in r["vec"]] for r in (e or Embedder(c)).transform(df).orderBy("row_id").collect()]
    for v in values(base.replace(vect_norm="l1")):
        assert abs(sum(v) - 1) < 1e-6
    for v in values(base.replace(vect_norm="l2")):
        assert abs(sum(x * x for x in v) - 1) < 1e-6
    for v in values(base.replace(vect_embed="bin")):
        assert sum(v) == len(v)
    fitted = Embedder(base.replace(vect_embed="tfidf")).fit(df)
    idf = {r.dim: r.idf for r in fitted.idf.collect()}
    for r in fitted.transform(df).collect():
        assert abs(sum(x["val"] / idf[x["dim"]] for x in r["vec"]) - 1) < 1e-6
    joined = fitted._joined_tfidf(df, "data", "vec", ["row_id"])
    assert sorted(map(str, joined.collect())) == sorted(map(str, fitted.transform(df).collect()))
    assert df.filter("false").transform(lambda d: Embedder(base).transform(d)).count() == 0
    assert Embedder(base).transform(df.select("row_id", F.lit(None).cast("string").alias("data"))).filter(F.size("vec") > 0).count() == 0
