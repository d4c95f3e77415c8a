"""Sources: each gives (row_id bigint, src string, label float, data binary)."""

from __future__ import annotations

import io
import logging
import re
import sys
import tarfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.labels import as_latin1, from_latin1, regex_label, suffix_label
from ..functions.preprocess import strip_newline, trim_blanks
from ..session import ship_package

log = logging.getLogger("hashloom")
COLUMNS = ("row_id", "src", "label", "data")


#: A table with a row for each file or block is broadcast up to so many rows (of about 100 bytes); beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line, value): the lines of text files, numbered from 0 in each file's
    own order.

    A line ends at a line feed only, and value has its bytes, of whatever encoding (as text with a character for each byte).  Numbers come from the places of lines within the
    blocks that a file is read in and the blocks' line counts, so no line is moved.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__m")
    )
    blocks = raw.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("__m").alias("__first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("path", "block", "__first", before.alias("__before"))
    n = len(raw.inputFiles()) + raw.rdd.getNumPartitions()
    out = raw.join(_sized(starts, n), ["path", "block"]).select("path", "block", (F.col("__before") + F.col("__m") - F.col("__first")).alias("line"), as_latin1(F.col("value")).alias("value"))
    out.blocks = n
    return out


def _listed(spark: SparkSession, path: str):
    """The file system of path, and the status of what it names or of what stands directly there."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(root) or []
    return fs, [s for f in found for s in (fs.listStatus(f.getPath()) if f.isDirectory() else [f])]


def _unterminated(spark: SparkSession, path: str) -> list[str]:
    """The plain files under path whose last byte isn't a line feed."""
    out = []
    fs, files = _listed(spark, path)
    for f in files:
        if f.isFile() and f.getLen():
            stream = fs.open(f.getPath())
            stream.seek(f.getLen() - 1)
            if stream.read() != 10:
                # as a metadata column shows it: escaped or not
                out += sorted({f.getPath().toString(), f.getPath().toUri().toString()})
            stream.close()
    return out


def _labelled(lines: DataFrame, pattern: str) -> DataFrame:
    """(row_id, src, label, data) from (row_id, src, value)."""
    found = lines.withColumn("__l", regex_label(from_latin1(F.col("value")), pattern))
    return found.select(F.col("row_id").cast("bigint"), "src", F.col("__l.label").alias("label"), F.col("__l.rest").alias("data"))


def lines(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """A record for each line; the label is the match of lines_regex, which is cut off with
    all before it.  Files follow each other by path; src counts the lines.

    With strict_compat an unterminated last line of an uncompressed file is dropped,
    and a line ends at its first zero byte.
    """
    rows = numbered_lines(spark, path)
    blocks = rows.blocks  # of which files have at least one
    if config.strict_compat:
        lost = _unterminated(spark, path)
        if lost:
            last = rows.groupBy("path").agg(F.max("line").alias("__last"))
            plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
            ends = plain(F.col("path")).isin([re.sub("^([a-z0-9]+):/+", r"\1:/", p) for p in lost])
            rows = rows.join(_sized(last, blocks), "path").filter(~(ends & (F.col("line") == F.col("__last")))).drop("__last")
        rows = rows.withColumn("value", F.substring_index("value", "\0", 1))
    sizes = rows.groupBy("path").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = _sized(sizes.select("path", before.alias("__offset")), blocks)
    row_id = F.col("__offset") + F.col("line")
    numbered = rows.join(offsets, "path").select(row_id.alias("row_id"), F.concat(F.lit("line"), row_id.cast("string")).alias("src"), strip_newline(F.col("value")).alias("value"))
    return _labelled(numbered, config.lines_regex)


def stdin(spark: SparkSession, path: str = "-", config: Config = Config(), stream: io.BufferedIOBase | None = None) -> DataFrame:
    """A record for each line of the standard input, an unterminated last one too."""
    rows = [(n, f"line{n}", bytearray(r.rstrip(b"\r\n"))) for n, r in enumerate(stream or sys.stdin.buffer)]
    df = spark.createDataFrame(rows, "row_id bigint, src string, raw binary")
    return _labelled(df.select("row_id", "src", as_latin1(F.col("raw")).alias("value")), config.lines_regex)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _empty_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the empty files directly in a folder, which Spark's reader leaves out."""
    found = [f.getPath() for f in _listed(spark, path)[1] if f.isFile() and not f.getLen()]
    return spark.createDataFrame([(p.toString(), bytearray()) for p in found if p.getName()[0] not in "._"], "path string, content binary")


def _ordered(df: DataFrame, *by: str) -> DataFrame:
    """row_id by the order of small columns only; the data is joined by its place."""
    return df.withColumn("row_id", F.row_number().over(W.orderBy(*by)) - 1)


def directory(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """A record for each file directly in the directory, by name; the label is that of the
    file's suffix.  Names that begin with a dot or an underscore are passed over, as in all of Spark."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    files = _files(spark, path).withColumn("__depth", F.length(parent) - F.length(F.regexp_replace(parent, "/", "")))
    top = files.agg(F.min("__depth").alias("__top"))
    files = files.join(F.broadcast(top), F.col("__depth") == F.col("__top")).select("path", "content").unionByName(_empty_files(spark, path))
    names = _ordered(files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("src")), "src", "path")
    rows = names.join(files.select("path", "content"), "path")
    return rows.select(F.col("row_id").cast("bigint").alias("row_id"), "src", suffix_label(F.col("src")).alias("label"), F.col("content").alias("data"))


def _members(content: bytes):
    """(name, bytes) of the regular files in a zip or tar archive (plain, gz, bz2 or xz)."""
    raw = io.BytesIO(content)
    if zipfile.is_zipfile(raw):
        with zipfile.ZipFile(raw) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, z.read(i)
        return
    raw.seek(0)
    with tarfile.open(fileobj=raw) as t:
        for m in t:
            if m.isreg():
                yield m.name, t.extractfile(m).read()


def archive(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """A record for each regular file in tar (plain, gz, bz2, xz) and zip archives, in their
    order; src is the member's path and the label that of its suffix."""
    ship_package(spark)

    def run(batches):
        for b in batches:
            rows = [(p, n, name, data) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (name, data) in enumerate(_members(c))]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.binary()))], names=["path", "n", "src", "data"])

    files = _files(spark, path)
    found = files.select("path", "content").mapInArrow(run, "path string, n bigint, src string, data binary")
    sizes = found.groupBy("path").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = _sized(sizes.select("path", before.alias("__offset")), len(files.inputFiles()))
    return found.join(offsets, "path").select((F.col("__offset") + F.col("n")).cast("bigint").alias("row_id"), "src", suffix_label(F.col("src")).alias("label"), "data")


def fasta(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """A record for each sequence; src is the whole header (of several in a row the first),
    the label that of fasta_regex in it.

    Lines are trimmed and blank ones skipped; > and ; begin headers; what stands before the
    first header is skipped, and headers without a sequence give no record.  Records
    are numbered within blocks of a file and across them from the blocks' counts.
    """
    read = numbered_lines(spark, path)
    rows = read.withColumn("value", trim_blanks(F.col("value"))).filter("value <> ''")
    rows = rows.withColumn("head", F.col("value").rlike("^[>;]"))
    in_block = W.partitionBy("path", "block").orderBy("line")
    marked = rows.withColumn("__prev", F.lag("head").over(in_block))
    begins = F.col("head") & ~F.coalesce("__prev", F.lit(False))
    marked = marked.withColumn("__begins", begins.cast("int"))
    # a block that opens with a header after one that closed with a header begins nothing there
    ends = marked.groupBy("path", "block").agg(F.sum("__begins").alias("n"), F.min_by("head", "line").alias("opens"), F.max_by("head", "line").alias("closes"))
    by_block = W.partitionBy("path").orderBy("block")
    ends = ends.withColumn("__joined", (F.col("opens") & F.coalesce(F.lag("closes").over(by_block), F.lit(False))).cast("int"))
    carried = F.coalesce(F.sum(F.col("n") - F.col("__joined")).over(by_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = _sized(ends.select("path", "block", "__joined", carried.alias("__before")), read.blocks)
    grouped = marked.join(starts, ["path", "block"]).withColumn("__g", F.sum("__begins").over(in_block) - F.col("__joined") + F.col("__before"))
    records = (
        grouped.filter("__g > 0")
        .groupBy("path", "__g")
        .agg(
            F.min_by("value", F.when(F.col("head"), F.col("line"))).alias("src"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line", "value")))), lambda s: s["value"]), "").alias("seq"),
        )
        .filter("seq <> ''")
    )
    ids = _ordered(records.select("path", "__g"), "path", "__g")
    head = from_latin1(F.col("src"))
    found = regex_label(head, config.fasta_regex)["label"]
    return records.join(ids, ["path", "__g"]).select(F.col("row_id").cast("bigint").alias("row_id"), head.cast("string").alias("src"), found.alias("label"), from_latin1(F.col("seq")).alias("data"))


def from_table(df: DataFrame, id_column: str, text_column: str, label_column: str | None = None, src_column: str | None = None) -> DataFrame:
    """A record for each row of any table."""
    label = F.coalesce(F.col(label_column).cast("float"), F.lit(0.0).cast("float")) if label_column else F.lit(0.0).cast("float")
    src = F.col(src_column).cast("string") if src_column else F.concat(F.lit("line"), F.col(id_column).cast("string"))
    return df.select(F.col(id_column).cast("bigint").alias("row_id"), src.alias("src"), label.alias("label"), F.col(text_column).cast("binary").alias("data"))


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores: one row group of a file, small as it is when compressed, is one
    task's, and may hold a million strings."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


SOURCES: dict[str, Callable[..., DataFrame]] = {"lines": lines, "stdin": stdin, "dir": directory, "arc": archive, "fasta": fasta}


def read_source(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """The source that the configuration names; "-" is the standard input, an unknown name is
    read as lines."""
    name = "stdin" if path == "-" else config.input_format.lower()
    if name not in SOURCES:
        log.error("unknown input format %r, reading lines", name)
        name = "lines"
    return SOURCES[name](spark, path, config)
