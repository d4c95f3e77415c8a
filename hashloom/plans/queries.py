"""The queries of this package's operators over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import labels as LB
from ..functions import preprocess as P
from ..functions import vectors as V
from ..operators import longform as L
from ..session import shared_dir
from ..sinks import writers as S
from ..sources.readers import from_table, read_source, spread
from . import oracle as O
from .embedder import Embedder

QUERIES: dict = {}
SQL: dict[str, str] = {}

DOCS = "SELECT doc_id AS row_id, text AS s FROM documents"
PARTS = "SELECT p_partkey AS row_id, p_name AS s FROM part"
TALK = "SELECT conv_id * 1000 + turn AS row_id, text AS s FROM conversations"
BENCH = "SELECT item_id AS row_id, text AS s FROM benchmark"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(lines: DataFrame, name: str) -> str:
    """A folder in the shared one with the column value as text files."""
    path = f"{shared_dir(lines.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    lines.write.text(path)
    return path


def _docs(spark, sf_dir) -> DataFrame:
    return from_table(_table(spark, sf_dir, "documents"), "doc_id", "text")


def _parts(spark, sf_dir) -> DataFrame:
    return from_table(spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name")), "p_partkey", "p_name")


def _talk(spark, sf_dir) -> DataFrame:
    t = _table(spark, sf_dir, "conversations").withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    return from_table(t, "row_id", "text")


def _bench(spark, sf_dir) -> DataFrame:
    return from_table(_table(spark, sf_dir, "benchmark"), "item_id", "text")


def _long(df: DataFrame, config: Config = Config(), engine: str = "arrow") -> DataFrame:
    return Embedder(config, engine).entries(df, ["data"], ["row_id"]).withColumn("val", F.col("val").cast("double"))


def round6(x: F.Column) -> F.Column:
    """round(x, 6) of a float as a double.  A float times 10^6 is exact in a double, so this gives what
    round's decimals give, at a fraction of their time."""
    def near(y: F.Column) -> F.Column:
        return F.floor(F.abs(y) * 1e6 + 0.5).cast("double") / 1e6

    y = x.cast("double")
    return F.when(F.abs(y) < 1e9, F.when(y < 0, -near(y)).otherwise(near(y)) + 0.0).otherwise(F.round(y, 6))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("val", round6(F.col("val")))


def _simple(name: str, rows, config: Config, sql: str, rounded: bool = False, engine: str = "arrow") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _long(rows(spark, sf_dir), config, engine)
        return _rounded(out) if rounded else out

    QUERIES[name], SQL[name] = run, sql


# ---- n-grams and counts

_simple("tok_count", _docs, Config(), f"{O.counts(DOCS)} {O.TOTALS}")
_simple("tok_count_catalyst", _parts, Config(), f"{O.counts(PARTS)} {O.TOTALS}", engine="catalyst")
_simple("tok_bin", _docs, Config(vect_embed="bin"), f"{O.counts(DOCS)} SELECT row_id, dim, 1.0::DOUBLE AS val FROM counts")
_simple("byte3_count", _parts, Config(granularity="bytes", ngram_len=3), f"WITH {O.byte_grams(PARTS, 3)}, {O.murmur()}, {O.dims()}, {O.COUNTS} {O.TOTALS}")
_simple("byte3_count_catalyst", _parts, Config(granularity="bytes", ngram_len=3), f"WITH {O.byte_grams(PARTS, 3)}, {O.murmur()}, {O.dims()}, {O.COUNTS} {O.TOTALS}", engine="catalyst")
_simple("token2_count", _docs, Config(ngram_len=2), f"{O.counts(DOCS, 2)} {O.TOTALS}")
_simple("tok_sorted3", _docs, Config(ngram_len=3, ngram_sort=True), f"{O.counts(DOCS, 3, sort=True)} {O.TOTALS}")
_simple("hash_bits12", _docs, Config(hash_bits=12), f"{O.counts(DOCS, bits=12)} {O.TOTALS}")
_simple("md5_hash", _docs, Config(hash_algorithm="md5"), f"WITH {O.token_grams(DOCS)}, {O.md5_hash()}, {O.dims()}, {O.COUNTS} {O.TOTALS}")
_simple("tok_pos", _talk, Config(ngram_pos=True), f"WITH {O.token_grams(TALK)}, {O.positions()}, {O.murmur('posed')}, {O.dims(22, 'posed')}, {O.COUNTS} {O.TOTALS}")
_simple("tok_pos_shift2", _talk, Config(ngram_pos=True, pos_shift=2), f"WITH {O.token_grams(TALK)}, {O.positions(2)}, {O.murmur('posed')}, {O.dims(22, 'posed')}, {O.COUNTS} {O.TOTALS}")


def _blended(source: str) -> str:
    parts = []
    for n in (1, 2, 3):
        parts.append(f"SELECT row_id, i AS pos, hex(encode(array_to_string(t[i + 1 : i + {n}], chr(10)))) AS x FROM toks, unnest(range(0, len(t) - {n - 1})) AS u(i)")
    head = O.token_grams(source).split(", grams AS (")[0]
    return f"WITH {head}, grams AS ({' UNION ALL '.join(parts)}), {O.murmur()}, {O.dims()}, {O.COUNTS}"


_simple("tok_blend3", _talk, Config(ngram_len=3, ngram_blend=True), f"{_blended(TALK)} {O.TOTALS}")

_SIGNED = f"WITH {O.token_grams(DOCS)}, {O.murmur()}, {O.dims()}"
_NOT_ZERO = "HAVING abs(sum(sgn)) > 1e-9"
_simple("signed_aligned", _docs, Config(vect_sign=True, sign_mode="aligned"), f"{_SIGNED} SELECT row_id, dim, sum(sgn)::DOUBLE AS val FROM feats GROUP BY row_id, dim {_NOT_ZERO}")
_simple(
    "signed_reference",
    _docs,
    Config(vect_sign=True),
    f"""{_SIGNED}, ranked AS (SELECT row_id, dim, row_number() OVER (PARTITION BY row_id ORDER BY dim) - 1 AS pos FROM feats),
zipped AS (SELECT r.row_id, r.dim, f.sgn FROM ranked r JOIN feats f ON r.row_id = f.row_id AND r.pos = f.pos)
SELECT row_id, dim, sum(sgn)::DOUBLE AS val FROM zipped GROUP BY row_id, dim {_NOT_ZERO}""",
)

# ---- norms, thresholds, embeddings

_L1 = "SELECT row_id, dim, (val / sum(val) OVER (PARTITION BY row_id))::FLOAT::DOUBLE AS val FROM counts"
_L2 = "SELECT row_id, dim, (val / sqrt(sum(val * val) OVER (PARTITION BY row_id)))::FLOAT::DOUBLE AS val FROM counts"
_simple("norm_l1", _docs, Config(vect_norm="l1"), f"{O.counts(DOCS)} SELECT row_id, dim, round(val, 6) AS val FROM ({_L1})", True)
_simple("norm_l2", _docs, Config(vect_norm="l2"), f"{O.counts(DOCS)} SELECT row_id, dim, round(val, 6) AS val FROM ({_L2})", True)
_simple(
    "thres_low_high",
    _docs,
    Config(vect_norm="l2", thres_low=0.0512, thres_high=0.4013),
    f"{O.counts(DOCS)} SELECT row_id, dim, round(val, 6) AS val FROM ({_L2}) WHERE val >= 0.0512 AND val <= 0.4013",
    True,
)

_IDF = """idf AS (
  SELECT dim, log2(((1.0::DOUBLE / count(*)::FLOAT)::FLOAT * (SELECT count(*) FROM src)::FLOAT)::FLOAT::DOUBLE)::FLOAT AS idf FROM counts GROUP BY dim
)"""


@query(f"{O.counts(DOCS)}, {_IDF} SELECT dim, round(idf::DOUBLE, 6) AS idf FROM idf")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Embedder(Config(vect_embed="tfidf")).fit(_docs(spark, sf_dir)).idf.select("dim", F.round(F.col("idf").cast("double"), 6).alias("idf"))


_TFIDF = f"""{O.counts(DOCS)}, {_IDF}, tf AS (SELECT row_id, dim, (val / sum(val) OVER (PARTITION BY row_id))::FLOAT AS tf FROM counts)
SELECT row_id, dim, round((tf::DOUBLE * idf::DOUBLE)::FLOAT::DOUBLE, 6) AS val FROM tf JOIN idf USING (dim) WHERE abs((tf::DOUBLE * idf::DOUBLE)::FLOAT) > 1e-9"""


@query(_TFIDF)
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _docs(spark, sf_dir)
    return _rounded(L.explode_vectors(Embedder(Config(vect_embed="tfidf")).fit(df).transform(df.select("row_id", "data"))))


@query(_TFIDF)
def tfidf_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF by the join that weights beyond the broadcast limit take."""
    df = _docs(spark, sf_dir)
    e = Embedder(Config(vect_embed="tfidf")).fit(df)
    return _rounded(L.explode_vectors(e._joined_tfidf(df, "data", "vec", ["row_id"])))


# ---- reductions

_simple(
    "simhash",
    _docs,
    Config(dim_reduce="simhash"),
    f"""{O.counts(DOCS)} SELECT row_id, j::BIGINT AS dim, 1.0::DOUBLE AS val FROM counts, unnest(range(0, 22)) AS u(j)
GROUP BY row_id, j HAVING sum(CASE WHEN (dim >> j) & 1 = 1 THEN val ELSE -val END) > 0""",
)
_simple(
    "minhash",
    _docs,
    Config(dim_reduce="minhash"),
    f"""{O.counts(DOCS)}, low AS (
  SELECT row_id, 0 AS r, min(dim::UBIGINT) AS m FROM counts GROUP BY row_id UNION ALL
  SELECT row_id, 1 AS r, min(xor(dim::UBIGINT, {O.rehash_literal(1)}) & 4194303::UBIGINT) AS m FROM counts GROUP BY row_id
), every AS (
  SELECT row_id, r, m FROM low UNION ALL
  SELECT row_id, r, 18446744073709551615::UBIGINT AS m FROM src, unnest([0, 1]) AS v(r) WHERE row_id NOT IN (SELECT row_id FROM low)
)
SELECT row_id, (r * 22 + j)::BIGINT AS dim, 1.0::DOUBLE AS val FROM every, unnest(range(0, 22)) AS u(j)
WHERE r * 22 + j < 32 AND (m >> j::UBIGINT) & 1::UBIGINT = 1""",
)
_simple(
    "bloom",
    _docs,
    Config(dim_reduce="bloom"),
    f"""{O.counts(DOCS)} SELECT DISTINCT row_id, (xor(dim::UBIGINT, k) % 32)::BIGINT AS dim, 1.0::DOUBLE AS val
FROM counts, unnest([{O.rehash_literal(0)}, {O.rehash_literal(1)}]) AS u(k)""",
)
for _kind in ("simhash", "minhash", "bloom"):
    _simple(f"{_kind}_catalyst", _parts, Config(dim_reduce=_kind), SQL[_kind].replace(DOCS, PARTS), engine="catalyst")

# ---- vector algebra

_AB = (
    O.counts(DOCS).replace("feats AS (", "feats AS (", 1)
    + f""", b AS (SELECT row_id, (h & 4194303::UBIGINT)::BIGINT AS dim, count(*)::DOUBLE AS val FROM (
  SELECT row_id, x FROM grams WHERE pos = 0) JOIN hashed USING (x) GROUP BY ALL)"""
)


def _text_and_first(spark, sf_dir) -> DataFrame:
    """Documents with their text and its first word."""
    t = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("row_id"), "text")
    return t.withColumn("first", F.regexp_extract("text", "^[ \n\r]*([^ \n\r]*)", 1))


def _a_and_b(spark, sf_dir) -> DataFrame:
    """Documents with the vector of the text and that of its first word."""
    return Embedder(Config()).transform_all(_text_and_first(spark, sf_dir), {"text": "a", "first": "b"}, ["row_id"])


def _a(spark, sf_dir) -> DataFrame:
    """Documents with the vector of the text."""
    t = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("row_id"), "text")
    return Embedder(Config()).transform(t, "text", "a")


def _vec(df: DataFrame, vec) -> DataFrame:
    return L.explode_vectors(df.select("row_id", vec.alias("vec"))).withColumn("val", round6(F.col("val")))


@query(f"{_AB} SELECT row_id, dim, sum(val) AS val FROM (SELECT * FROM counts UNION ALL SELECT * FROM b) GROUP BY row_id, dim")
def vec_add(spark, sf_dir):
    both = Embedder(Config()).entries(_text_and_first(spark, sf_dir), ["text", "first"], ["row_id"])
    return both.withColumn("val", round6(F.col("val")))


@query(f"{_AB} SELECT row_id, dim, c.val * b.val AS val FROM counts c JOIN b USING (row_id, dim)")
def vec_times(spark, sf_dir):
    return _vec(_a_and_b(spark, sf_dir), V.times(F.col("a"), F.col("b")))


@query(f"{_AB} SELECT row_id, sum(c.val * b.val) AS dot FROM counts c JOIN b USING (row_id, dim) GROUP BY row_id")
def vec_dot(spark, sf_dir):
    return _a_and_b(spark, sf_dir).select("row_id", V.dot(F.col("a"), F.col("b")).alias("dot")).filter("dot <> 0")


@query(f"{O.counts(DOCS)} SELECT row_id, dim, val * 2.5 AS val FROM counts")
def vec_mul(spark, sf_dir):
    return _vec(_a(spark, sf_dir), V.mul(F.col("a"), 2.5))


@query(f"{O.counts(DOCS)} SELECT row_id, dim, round(log2(val)::FLOAT::DOUBLE, 6) AS val FROM counts")
def vec_log2(spark, sf_dir):
    return _vec(_a(spark, sf_dir), V.log2(F.col("a")))


@query(f"{O.counts(DOCS)} SELECT row_id, dim, round((1.0 / val)::FLOAT::DOUBLE, 6) AS val FROM counts")
def vec_invert(spark, sf_dir):
    return _vec(_a(spark, sf_dir), V.invert(F.col("a")))


@query(f"{O.counts(DOCS)} SELECT row_id, dim, 1.0::DOUBLE AS val FROM counts")
def vec_binarize(spark, sf_dir):
    return _vec(_a(spark, sf_dir), V.binarize(F.col("a")))


@query(f"{_AB} SELECT row_id, (SELECT count(*) FROM counts c WHERE c.row_id = s.row_id) = (SELECT count(*) FROM counts c JOIN b USING (row_id, dim) WHERE c.row_id = s.row_id AND c.val = b.val) AS same FROM src s")
def vec_equals(spark, sf_dir):
    return _a_and_b(spark, sf_dir).select("row_id", V.equals(F.col("a"), F.col("b")).alias("same"))


_PAIRS = f"""{O.counts(DOCS)},
{O.token_grams(BENCH).replace('src AS', 'src2 AS').replace('toks', 'toks2').replace('grams', 'grams2').replace('FROM src)', 'FROM src2)').replace('FROM src\n', 'FROM src2\n')},
{O.murmur('grams2', out='hashed2')},
items AS (SELECT row_id, (h & 4194303::UBIGINT)::BIGINT AS dim, count(*)::DOUBLE AS val FROM grams2 JOIN hashed2 USING (x) GROUP BY ALL)"""


@query(f"{_PAIRS} SELECT c.row_id, i.row_id AS item_id, sum(c.val * i.val) AS dot FROM counts c JOIN items i USING (dim) GROUP BY ALL")
def vec_dot_pairs(spark, sf_dir):
    items = _long(_bench(spark, sf_dir)).withColumnRenamed("row_id", "item_id")
    return L.dot_pairs(_long(_docs(spark, sf_dir)), items, "row_id", "item_id")


@query(f"{O.counts(DOCS)} SELECT dim, sum(val) AS val FROM counts GROUP BY dim")
def vec_sum(spark, sf_dir):
    return Embedder(Config()).total(_docs(spark, sf_dir)).withColumn("val", F.col("val").cast("double"))


@query(f"{_PAIRS}, total AS (SELECT dim, sum(val) AS t FROM items GROUP BY dim) SELECT row_id, dim, val * t AS val FROM counts JOIN total USING (dim)")
def vec_times_join(spark, sf_dir):
    total = Embedder(Config()).total(_bench(spark, sf_dir))
    return L.product_join(_long(_docs(spark, sf_dir)), total).withColumn("val", F.col("val").cast("double"))


_DENSE = "WITH d AS (SELECT vec_id, label, (i - 1)::BIGINT AS dim, embedding[i] AS val FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i))"


def _dense(spark, sf_dir) -> DataFrame:
    cells = F.transform("embedding", lambda v, i: F.struct(i.cast("bigint").alias("dim"), v.cast("float").alias("val")))
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", cells.alias("vec"))


@query(f"{_DENSE} SELECT vec_id, dim, round((val::DOUBLE / sqrt(sum(val::DOUBLE * val::DOUBLE) OVER (PARTITION BY vec_id)))::FLOAT::DOUBLE, 5) + 0.0 AS val FROM d")
def dense_norm_l2(spark, sf_dir):
    long = L.explode_vectors(_dense(spark, sf_dir).select("vec_id", V.norm(F.col("vec"), "l2").alias("vec")))
    return long.withColumn("val", F.round(F.col("val").cast("double"), 5) + 0.0)


@query(f"{_DENSE}, c AS (SELECT label, dim, sum(val::DOUBLE)::FLOAT AS val FROM d GROUP BY label, dim) SELECT vec_id, round(sum((d.val * c.val)::FLOAT::DOUBLE), 3) AS dot FROM d JOIN c USING (label, dim) GROUP BY vec_id")
def dense_dot(spark, sf_dir):
    long = L.explode_vectors(_dense(spark, sf_dir))
    centre = L.implode_vectors(L.sum_vectors(long.withColumn("val", F.col("val").cast("double")), ["label"]), ["label"], vec="centre")
    return _dense(spark, sf_dir).join(centre, "label").select("vec_id", F.round(V.dot(F.col("vec"), F.col("centre")), 3).alias("dot"))


# ---- dictionary

_NAMED = f"WITH {O.token_grams(DOCS)}, {O.murmur()}, {O.dims(12)}, ranked AS (SELECT *, first_value(x) OVER (PARTITION BY dim ORDER BY row_id, pos) AS won FROM feats)"


@query(f"{_NAMED} SELECT dim, min(won) AS feat, count(*) AS insertions, count(*) FILTER (WHERE x <> won) AS collisions FROM ranked GROUP BY dim")
def dictionary(spark, sf_dir):
    entries = Embedder(Config(hash_bits=12)).dictionary(_docs(spark, sf_dir))
    return entries.select("dim", F.hex("feat").alias("feat"), "insertions", "collisions")


@query(f"{_NAMED} SELECT count(DISTINCT dim) AS size, count(*) AS insertions, count(*) FILTER (WHERE x <> won) AS collisions, round(100.0 * count(*) FILTER (WHERE x <> won) / count(*), 6) AS collision_rate FROM ranked")
def collisions(spark, sf_dir):
    stats = L.collision_stats(Embedder(Config(hash_bits=12)).dictionary(_docs(spark, sf_dir)))
    return stats.withColumn("collision_rate", F.round("collision_rate", 6))


@query(
    f"""WITH {O.token_grams(TALK)}, {O.murmur()}, {O.dims(12)}, ranked AS (
  SELECT *, row_id // 256 AS chunk, first_value(x) OVER (PARTITION BY row_id // 256, dim ORDER BY row_id, pos) AS won FROM feats)
SELECT chunk, dim, min(won) AS feat FROM ranked GROUP BY chunk, dim"""
)
def dictionary_chunked(spark, sf_dir):
    entries = Embedder(Config(hash_bits=12)).dictionary(_talk(spark, sf_dir), chunked=True)
    return entries.select("chunk", "dim", F.hex("feat").alias("feat"))


# ---- preprocessing

_STOP = ["the", "of", "and", "der", "de", "la"]


@query(
    "SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[ \\n\\r]|[^ \\n\\r]+'), "
    f"lambda p: NOT list_contains([{', '.join(repr(s) for s in _STOP)}], p)), '') AS text FROM documents"
)
def stop_filter(spark, sf_dir):
    out = P.stop_filter(F.col("text").cast("binary"), _STOP, Config().delims)
    return _table(spark, sf_dir, "documents").select("doc_id", out.cast("string").alias("text"))


_STOPPED = DOCS + " WHERE false"
_simple_stop = ", ".join(repr(s) for s in _STOP)


@query(f"{O.counts(DOCS)}, gone AS (SELECT x FROM grams WHERE g IN ({_simple_stop})) SELECT f.row_id, f.dim, count(*)::DOUBLE AS val FROM feats f WHERE x NOT IN (SELECT x FROM gone) GROUP BY f.row_id, f.dim")
def stop_embed(spark, sf_dir):
    e = Embedder(Config(), stop_tokens=[s.encode() for s in _STOP])
    return L.explode_vectors(e.transform(_docs(spark, sf_dir).select("row_id", "data"))).withColumn("val", F.col("val").cast("double"))


@query("SELECT p_partkey, p_name FROM part")
def uri_decode(spark, sf_dir):
    coded = F.regexp_replace(F.regexp_replace("p_name", " ", "%20"), "a", "%61")
    return _table(spark, sf_dir, "part").select("p_partkey", P.uri_decode(coded.cast("binary")).cast("string").alias("p_name"))


@query("SELECT event_id, reverse(props) AS props FROM events")
def reverse_bytes(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", P.reverse_bytes(F.col("props").cast("binary")).cast("string").alias("props"))


@query("SELECT item_id, rtrim(trim(text, ' '), chr(10)) AS text FROM (SELECT item_id, '  ' || text || chr(10) || chr(10) AS text FROM benchmark)".replace("rtrim(trim(text, ' '), chr(10))", "trim(text, ' ' || chr(10))"))
def trim_blanks(spark, sf_dir):
    t = _table(spark, sf_dir, "benchmark")
    return t.select("item_id", P.trim_blanks(F.concat(F.lit("  "), "text", F.lit("\n\n"))).alias("text"))


# ---- labels

@query("SELECT p_partkey, p_size::DOUBLE AS label, ' ' || p_name AS rest FROM part")
def label_regex(spark, sf_dir):
    t = _table(spark, sf_dir, "part")
    found = LB.regex_label(F.concat(F.lit("+"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name")), Config().lines_regex)
    return t.select("p_partkey", found["label"].cast("double").alias("label"), found["rest"].cast("string").alias("rest"))


@query(
    f"""WITH grams AS (SELECT page_id AS row_id, hex(encode(regexp_extract(url, '([^.]*)$', 1))) AS x FROM pages), {O.murmur('grams', O.LABEL_SEED)}
SELECT row_id AS page_id, (h % 65535)::DOUBLE AS label FROM grams JOIN hashed USING (x)"""
)
def label_suffix(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", LB.suffix_label(F.col("url")).cast("double").alias("label"))


# ---- sinks

@query(f"{O.counts(PARTS, 3)} SELECT row_id, (SELECT count(*) FROM counts c WHERE c.row_id = s.row_id) AS entries FROM src s")
def null_vectors_n3(spark, sf_dir):
    out = Embedder(Config(ngram_len=3)).transform(_parts(spark, sf_dir).select("row_id", "data"))
    return out.select("row_id", F.size("vec").cast("bigint").alias("entries"))


@query(f"{O.counts(DOCS, 3)} SELECT row_id, count(*) AS entries FROM counts GROUP BY row_id")
def skip_null(spark, sf_dir):
    out = S.skip_null(Embedder(Config(ngram_len=3)).transform(_docs(spark, sf_dir).select("row_id", "data")))
    return out.select("row_id", F.size("vec").cast("bigint").alias("entries"))


# ---- sources, over files made of a table; \xe9 is no UTF-8

def _bytes(text: str) -> F.Column:
    return F.lit(bytearray(text.encode("latin-1"))).cast("string")


@query("SELECT p_size::DOUBLE AS label, hex(encode(' caf')) || 'E9' || hex(encode(' ' || p_name)) AS data FROM part")
def source_lines(spark, sf_dir):
    t = _table(spark, sf_dir, "part").select(F.concat(F.lit("+"), F.col("p_size").cast("string"), F.lit(" caf"), _bytes("\xe9 "), "p_name").alias("value"))
    got = read_source(spark, files_of(t, "lines"), Config())
    return got.select(F.col("label").cast("double").alias("label"), F.hex("data").alias("data"))


@query("SELECT DISTINCT p_partkey::DOUBLE AS label, hex(encode(replace(p_name, ' ', ''))) || 'E9' AS data FROM part")
def source_fasta(spark, sf_dir):
    words = F.concat_ws("\n", F.split("p_name", " "))
    t = _table(spark, sf_dir, "part").select(F.concat(F.lit("> part "), F.col("p_partkey").cast("string"), F.lit(" of all\n  "), words, _bytes("\xe9")).alias("value"))
    got = read_source(spark, files_of(t, "fasta"), Config(input_format="fasta", fasta_regex=" [0-9]+"))
    return got.select(F.col("label").cast("double").alias("label"), F.hex("data").alias("data")).distinct()


_CELL = "(dim + 1)::VARCHAR || ':' || val::BIGINT::VARCHAR"


def _labelled(spark, sf_dir) -> DataFrame:
    marks = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").join(marks, "doc_id", "left")
    return Embedder(Config()).transform(from_table(docs, "doc_id", "text", "quality"))


_SPINE = "lines AS (SELECT row_id, string_agg({cell}, '{glue}' ORDER BY dim) AS v FROM counts GROUP BY row_id)"


@query(
    f"""{O.counts(DOCS)}, {_SPINE.format(cell=_CELL + " || ' '", glue='')}
SELECT row_id, coalesce(quality, 0)::VARCHAR || ' ' || coalesce(v, '') || '# line' || row_id::VARCHAR AS value
FROM src LEFT JOIN lines USING (row_id) LEFT JOIN (SELECT doc_id AS row_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (row_id)"""
)
def sink_libsvm(spark, sf_dir):
    return S.formatted(_labelled(spark, sf_dir), "libsvm")


@query(
    f"""{O.counts(DOCS)}, {_SPINE.format(cell="(dim + 1)::VARCHAR || '::' || val::BIGINT::VARCHAR", glue=',')}
SELECT row_id, coalesce(v, '') || ' # line' || row_id::VARCHAR AS value FROM src LEFT JOIN lines USING (row_id)"""
)
def sink_text(spark, sf_dir):
    return S.formatted(Embedder(Config()).transform(_docs(spark, sf_dir)), "text")


@query(
    f"""{O.counts(PARTS)}, lines AS (SELECT row_id, string_agg((dim + 1)::VARCHAR, ',' ORDER BY dim) AS d, string_agg(val::BIGINT::VARCHAR, ',' ORDER BY dim) AS v FROM counts GROUP BY row_id)
SELECT row_id, '{{"dim":[' || coalesce(d, '') || '],"val":[' || coalesce(v, '') || '],"src":"line' || row_id::VARCHAR || '"}}' AS value FROM src LEFT JOIN lines USING (row_id)"""
)
def sink_json_lines(spark, sf_dir):
    return S.formatted(Embedder(Config()).transform(_parts(spark, sf_dir)), "json")


@query(f"{O.counts(DOCS)}, {_SPINE.format(cell=_CELL.replace(chr(39) + ':' + chr(39), chr(39) + ' ' + chr(39)), glue=' ')} SELECT row_id, coalesce(v, '') AS value FROM src LEFT JOIN lines USING (row_id)")
def sink_cluto(spark, sf_dir):
    return S.formatted(Embedder(Config()).transform(_docs(spark, sf_dir)), "cluto")


@query(f"{O.counts(DOCS)} SELECT printf('%12d %12d %12d', (SELECT count(*) FROM src), 4194304, (SELECT count(*) FROM counts)) AS value")
def sink_cluto_header(spark, sf_dir):
    return S.cluto_header(Embedder(Config()).transform(_docs(spark, sf_dir)), 22)


@query(f"{O.counts(PARTS)}, ids AS (SELECT dim, row_number() OVER (ORDER BY dim) - 1 AS c FROM (SELECT DISTINCT dim FROM counts)) SELECT row_id, c AS \"column\", dim, val FROM counts JOIN ids USING (dim)")
def matrix_coordinates(spark, sf_dir):
    from ..sinks.matrix import coordinates

    return coordinates(Embedder(Config()).transform(_parts(spark, sf_dir))).withColumn("val", F.col("val").cast("double"))


@query(f"{O.counts(BENCH)} {O.TOTALS}")
def sql_functions(spark, sf_dir):
    from ..sqlfuncs import register

    register(spark)
    _bench(spark, sf_dir).createOrReplaceTempView("hl_items")
    return spark.sql("SELECT row_id, e.dim, CAST(e.val AS double) AS val FROM (SELECT row_id, explode(hl_embed(data)) AS e FROM hl_items)")


# ---- streaming

@query(f"{O.counts(DOCS)} {O.TOTALS}")
def stream_embed(spark, sf_dir):
    """The documents as a stream, embedded in append mode."""
    from ..streaming import embed_stream

    path = f"{sf_dir}/documents.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    embed_stream(from_table(stream, "doc_id", "text").select("row_id", "data"), Embedder(Config()), f"{base}/out", f"{base}/state").awaitTermination()
    return L.explode_vectors(spark.read.parquet(f"{base}/out")).withColumn("val", F.col("val").cast("double"))
