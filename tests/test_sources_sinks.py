"""Readers, writers, codecs, command line."""

import gzip
import io
import json
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from corpus import CASES, LINES
from hashloom import cli
from hashloom.config import Config, ConfigError, load, parse
from hashloom.plans import Embedder
from hashloom.sinks import codecs, formats, writers
from hashloom.sinks.matrix import coordinates, ml_vectors
from hashloom.sources import read_source
from hashloom.sources.readers import from_table, stdin


def rows(df):
    return [(r.row_id, r.src, r.label, bytes(r.data)) for r in df.orderBy("row_id").collect()]


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"+1 a b\r\n-3x c\nx\ry\n\n12 d")
    want = [(0, "line0", 1.0, b" a b"), (1, "line1", -3.0, b"x c"), (2, "line2", 0.0, b"x\ry"), (3, "line3", 0.0, b""), (4, "line4", 12.0, b" d")]
    path = str(tmp_path / "a.txt")
    assert rows(read_source(spark, path)) == want
    assert rows(read_source(spark, path, Config(strict_compat=True))) == want[:-1]
    assert rows(read_source(spark, path, Config(input_format="no such"))) == want
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"q\nr\n"))
    assert [r[3] for r in rows(read_source(spark, str(tmp_path / "b.txt.gz")))] == [b"q", b"r"]
    assert rows(stdin(spark, stream=io.BytesIO(b"1 a\nb"))) == [(0, "line0", 1.0, b" a"), (1, "line1", 0.0, b"b")]


def test_bytes_that_are_no_text(spark, tmp_path):
    raw = bytes(k for k in range(256) if k not in (10, 13))
    (tmp_path / "a.txt").write_bytes(b"1 caf\xe9 x\n" + raw + b"\n")
    assert [(r[2], r[3]) for r in rows(read_source(spark, str(tmp_path / "a.txt")))] == [(1.0, b" caf\xe9 x"), (0.0, raw)]
    assert rows(stdin(spark, stream=io.BytesIO(b"1 caf\xe9 x")))[0][2:] == (1.0, b" caf\xe9 x")
    (tmp_path / "b.fa").write_bytes(b"> s\xe9q +2\nA\xe9C\n \xff\n")
    (r,) = rows(read_source(spark, str(tmp_path / "b.fa"), Config(input_format="fasta")))
    assert r[2:] == (2.0, b"A\xe9C\xff")


def test_strict_compat_looks_at_whole_paths(spark, tmp_path):
    for name, data in (("a", b"1\n2"), ("b", b"3\n4\n"), ("c d", b"5\n6")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.txt").write_bytes(data)
    got = rows(read_source(spark, str(tmp_path / "*" / "f.txt"), Config(strict_compat=True)))
    assert [r[2] for r in got] == [1.0, 3.0, 4.0, 5.0]


def test_lines_of_sinks_one_by_one(spark):
    """The vectorised lines against each row's own, with odd values, sources and missing vectors."""
    odd = [0.0, -0.0, 1.5, 1e-7, 123456789.0, float("inf"), float("nan"), 1 / 3]
    data = [(k, s, label, v) for k, (s, label, v) in enumerate([("a b", 1.0, [(5, x) for x in odd]), (None, None, []), ("", -2.5, [(-1, 1.0), (0, 2.0)]), ('q"\u00e9', 0.1, None)])]
    df = spark.createDataFrame(data, "row_id bigint, src string, label float, vec array<struct<dim:bigint,val:float>>").coalesce(1)
    one = {
        "libsvm": lambda r: formats.libsvm_line(formats.pairs(r.vec), r.label or 0.0, r.src), "text": lambda r: formats.text_line(formats.pairs(r.vec), r.src),
        "json": lambda r: formats.json_record(formats.pairs(r.vec), r.src), "cluto": lambda r: formats.cluto_line(formats.pairs(r.vec)),
    }
    for kind, line in one.items():
        assert {r.row_id: r.value for r in writers.formatted(df, kind).collect()} == {r.row_id: line(r) for r in df.collect()}


def test_line_numbers_over_blocks(spark, tmp_path):
    (tmp_path / "n.txt").write_text("".join(f"x{k}\n" for k in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = read_source(spark, str(tmp_path / "n.txt"))
        assert got.rdd.getNumPartitions() > 3
        assert [(r[0], r[3]) for r in rows(got)] == [(k, f"x{k}".encode()) for k in range(5000)]
        fa = "".join(f">s{k} +{k}\nAC\nGT{k}\n" for k in range(1500))
        (tmp_path / "f.fa").write_text(fa)
        got = rows(read_source(spark, str(tmp_path / "f.fa"), Config(input_format="fasta")))
        assert got == [(k, f">s{k} +{k}", float(k), f"ACGT{k}".encode()) for k in range(1500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text("lost\n\n>one +1\n;note\n AC \n\nGT\n>empty -1\n; second\nTT\n>last\n")
    got = rows(read_source(spark, str(tmp_path / "x.fa"), Config(input_format="fasta")))
    assert got == [(0, ">one +1", 1.0, b"ACGT"), (1, ">empty -1", -1.0, b"TT")]


def test_directory_and_archives(spark, tmp_path):
    d = tmp_path / "d"
    (d / "sub").mkdir(parents=True)
    for name, data in (("a.1", b"A\0"), ("b.-1", b"\xff"), ("noext", b"")):
        (d / name).write_bytes(data)
    (d / "sub" / "z.9").write_bytes(b"no")
    (d / "link.7").symlink_to(d / "a.1")
    got = rows(read_source(spark, str(d), Config(input_format="dir")))
    assert [r[1] for r in got] == ["a.1", "b.-1", "link.7", "noext"]
    assert [r[3] for r in got] == [b"A\0", b"\xff", b"A\0", b""]
    assert [r[2] for r in got[:3]] == [1.0, -1.0, 7.0]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d.x/f", b"1")
        z.writestr("e.2", b"2")
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        for name, data in (("d.x/f", b"1"), ("e.2", b"2")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    for name in ("x.zip", "x.tar.gz"):
        got = rows(read_source(spark, str(tmp_path / name), Config(input_format="arc")))
        assert [(r[0], r[1], r[3]) for r in got] == [(0, "d.x/f", b"1"), (1, "e.2", b"2")]
        assert got[1][2] == 2.0


@pytest.fixture(scope="module")
def vectors(spark):
    df = spark.createDataFrame([(k, x.decode()) for k, x in enumerate(LINES)], "row_id bigint, text string")
    return Embedder(Config(ngram_len=3, hash_bits=12)).transform(from_table(df, "row_id", "text")).cache()


def test_text_sinks(spark, vectors, tmp_path):
    c = Config(ngram_len=3, hash_bits=12)
    for kind in ("libsvm", "text", "list", "cluto", "json", "nonsense"):
        writers.write_vectors(vectors, str(tmp_path / kind), c.replace(output_format=kind), single_file=True)
    held = {r.row_id: formats.pairs(r["vec"]) for r in vectors.collect()}
    entries = sum(map(len, held.values()))
    svm = (tmp_path / "libsvm").read_text().splitlines()
    assert svm[3] == "0 # line3" and svm[0] == "0 " + "".join(f"{d + 1}:1 " for d, _ in held[0]) + "# line0"
    text = (tmp_path / "text").read_text().splitlines()
    assert text[0].startswith("# ") and text[4] == " # line3"
    assert (tmp_path / "list").read_text() == (tmp_path / "text").read_text()
    cluto = (tmp_path / "cluto").read_text().splitlines()
    assert cluto[0] == f"{8:12d} {4096:12d} {entries:12d}" and cluto[4] == ""
    data = json.loads((tmp_path / "json").read_text())
    assert [x["src"] for x in data] == [f"line{k}" for k in range(8)] and data[0]["dim"] == [d + 1 for d, _ in held[0]]
    writers.write_vectors(vectors.filter("false"), str(tmp_path / "none"), c.replace(output_format="json"), single_file=True)
    assert json.loads((tmp_path / "none").read_text()) == []
    writers.write_vectors(vectors, str(tmp_path / "parts"), c.replace(output_format="libsvm", skip_null=True))
    assert spark.read.text(str(tmp_path / "parts")).count() == sum(1 for v in held.values() if v)
    out = io.StringIO()
    writers._write_stdout(vectors, "-", c, True, out)
    assert out.getvalue() == (tmp_path / "text").read_text()


def test_features_in_sinks(spark, tmp_path):
    df = from_table(spark.createDataFrame([(0, "a, b"), (1, "%x b")], "i bigint, t string"), "i", "t")
    e = Embedder(Config())
    out = writers.with_features(e.transform(df), e.dictionary(df))
    got = {r.row_id: r.value for r in writers.formatted(out, "text").collect()}
    assert sorted(x.split(":")[1] for x in got[0].split(" #")[0].split(",")) == ["a%2c", "b"]
    assert "%25x" in got[1]
    js = json.loads(next(r.value for r in writers.formatted(out, "json").collect() if r.row_id == 0))
    assert sorted(js["feat"]) == ["a,", "b"]


def element(b, at):
    kind, size = struct.unpack_from("<II", b, at)
    if kind >> 16:  # a small element
        return kind & 0xFFFF, b[at + 4 : at + 4 + (kind >> 16)], at + 8
    return kind, b[at + 8 : at + 8 + size], at + 8 + size + (-size % 8 if kind != 14 else 0)


def children(b):
    at, out = 0, []
    while at < len(b):
        kind, data, at = element(b, at)
        out.append((kind, data))
    return out


def test_matlab(vectors, tmp_path):
    c = Config(ngram_len=3, hash_bits=12, output_format="matlab")
    writers.write_vectors(vectors, str(tmp_path / "m.mat"), c)
    raw = (tmp_path / "m.mat").read_bytes()
    assert len(raw[:128]) == 128 and raw[126:128] == b"IM"
    kind, body, end = element(raw, 128)
    assert kind == 14 and end == len(raw)
    parts = children(body)
    assert struct.unpack("<2i", parts[1][1]) == (1, 8) and parts[2][1] == b"fvec"
    assert parts[4][1].rstrip(b"\0").split(b"\0")[0] == b"data"
    held = {r.row_id: formats.pairs(r["vec"]) for r in vectors.collect()}
    for k in range(8):
        data, src, label = (children(p[1]) for p in parts[5 + 3 * k : 8 + 3 * k])
        n = len(held[k])
        assert struct.unpack("<2i", data[1][1]) == (4096, 1)
        assert list(struct.unpack(f"<{n}i", data[3][1])) == [d for d, _ in held[k]]
        assert list(struct.unpack(f"<{n}d", data[5][1])) == [v for _, v in held[k]]
        assert src[3][1].decode("utf-16-le") == f"line{k}"
        assert struct.unpack("<d", label[3][1]) == (0.0,)
    with pytest.raises(ValueError):
        writers.write_vectors(vectors, str(tmp_path / "n.mat"), c.replace(hash_bits=32))


def test_codecs(spark, tmp_path):
    entries = [(1, 0.5), (-1, 2.0)]
    codecs.save_vector(str(tmp_path / "v"), entries, 3, 1.0, "s")
    assert codecs.load_vector(str(tmp_path / "v")) == (entries, {"total": 3, "label": 1.0, "src": "s"})
    feats = [(0, b"a b"), (-1, b"\xff%:\0"), (256, b"")]
    codecs.save_dictionary(str(tmp_path / "d"), spark.createDataFrame([(d, bytearray(f)) for d, f in feats], "dim bigint, feat binary"))
    got = {(r.dim, bytes(r.feat)) for r in codecs.load_dictionary(spark, str(tmp_path / "d")).collect()}
    assert got == set(feats)
    with gzip.open(tmp_path / "q", "wt") as f:
        f.write("fhash: len=1\n  bin=0000000000000001: %ffffffe4x\n")
    assert bytes(codecs.load_dictionary(spark, str(tmp_path / "q")).first().feat) == b"\xe4x"


def test_matrices(vectors):
    got = coordinates(vectors)
    assert got.agg(F.max("column") + 1).first()[0] == got.select("dim").distinct().count()
    v = ml_vectors(vectors, 12).filter("row_id = 0").first().features
    assert v.size == 4096 and v.numNonzeros() == 1


def test_config(tmp_path):
    text = """
    # comment
    input = { input_format = "fasta"; decode_str = true; };  // more
    features : { ngram_len = 2, granularity = "bytes"; token_delim = "%20" "%0a"; thres_low = 1; hash_bits = 0x10; vect_sign = 1 }
    """
    (tmp_path / "c.cfg").write_text(text)
    c = load(tmp_path / "c.cfg", ngram_len=4)
    assert (c.input_format, c.decode_str, c.ngram_len, c.granularity, c.token_delim, c.thres_low, c.hash_bits, c.vect_sign) == ("fasta", True, 4, "bytes", "%20%0a", 1.0, 16, True)
    again = parse(c.to_text())
    assert again["features"]["hash_bits"] == 16 and again["input"]["decode_str"] is True
    for bad in ({"ngram_len": 0}, {"token_delim": ""}, {"thres_low": 2.0, "thres_high": 1.0}, {"explicit_hash": True, "hash_file": "x"}, {"hash_bits": 0}, {"token_delim": "", "granularity": "bytes", "stoptoken_file": "x"}, {"ngram_len": "3"}):
        with pytest.raises(ConfigError):
            Config(**bad)
    assert Config(granularity="words").granularity == "bytes" and Config(vect_norm="max").vect_norm == "none"
    for broken in ("features = { granularity = \"bytes\"; }", "features = { ngram_delim = \" \"; granularity = \"bytes\"; token_delim = \"\"; }", "x = ;"):
        (tmp_path / "b.cfg").write_text(broken)
        with pytest.raises(ConfigError):
            load(tmp_path / "b.cfg")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_bytes(b"\n".join(LINES) + b"\n")
    assert cli.main([*"-n 3 -o text --single_file".split(), str(tmp_path / "in.txt"), str(tmp_path / "out.txt")], spark) == 0
    import hashlib

    got = (tmp_path / "out.txt").read_text().splitlines()[1:]
    assert hashlib.sha256("\n".join(got).encode()).hexdigest()[:24] == dict((str(o), d) for o, d in CASES)[str({"ngram_len": 3})]
    weights = tmp_path / "w.fv"
    args = ["-E", "tfidf", "--tfidf_file", str(weights), "--hash_file", str(tmp_path / "h"), "-o", "text", "--single_file", str(tmp_path / "in.txt")]
    assert cli.main([*args, str(tmp_path / "o1")], spark) == 0 and weights.exists() and (tmp_path / "h").exists()
    assert cli.main([*args, str(tmp_path / "o2")], spark) == 0
    assert (tmp_path / "o1").read_text() == (tmp_path / "o2").read_text()
    assert cli.main(["-X", "-o", "json", "--single_file", str(tmp_path / "in.txt"), str(tmp_path / "j")], spark) == 0
    assert "feat" in json.loads((tmp_path / "j").read_text())[0]
    assert cli.main(["-D"]) == 0 and "hash_bits = 22" in capsys.readouterr().out
    assert cli.main(["-n", "0", "a", "b"]) == 2 and cli.main([]) == 2
