"""Embedding in Structured Streaming.

Embedding is row-local, so a stream is transformed by the very plan of a batch and is
written in append mode without state.  IDF weights are a fixed table that was fitted
before; a feature dictionary grows by merging each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..functions.labels import as_latin1, from_latin1, regex_label
from ..functions.preprocess import strip_newline
from ..plans.embedder import Embedder


def line_stream(spark: SparkSession, path: str, config: Config = Config(), files_per_trigger: int | None = None) -> DataFrame:
    """(src, label, data) of the lines of text files that appear in a folder; src is the
    file's name, as lines of a stream have no number."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.text(path).select("value", F.col("_metadata.file_name").alias("src"))
    found = raw.withColumn("__l", regex_label(from_latin1(strip_newline(as_latin1(F.col("value")))), config.lines_regex))
    return found.select("src", F.col("__l.label").alias("label"), F.col("__l.rest").alias("data"))


def embed_stream(stream: DataFrame, embedder: Embedder, path: str, checkpoint: str, trigger: dict | None = None, column: str = "data") -> StreamingQuery:
    """Starts a query that appends the vectors to Parquet files under path."""
    out = embedder.transform(stream, column)
    writer = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def dictionary_stream(stream: DataFrame, embedder: Embedder, path: str, checkpoint: str, row_id: str = "row_id") -> StreamingQuery:
    """Starts a query that keeps a feature dictionary: each micro-batch's first n-grams go to
    path/batch=N, where a batch that runs again replaces its own; `merged_dictionary` reads it."""

    def merge(batch: DataFrame, number: int) -> None:
        embedder.dictionary(batch, row_id).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary over all micro-batches: the earliest n-gram of a dim wins."""
    rows = spark.read.parquet(path)
    first = F.min_by("feat", "batch")
    grouped = rows.groupBy("dim", "feat").agg(F.min("batch").alias("batch"), F.sum("insertions").alias("insertions"))
    return grouped.groupBy("dim").agg(first.alias("feat"), F.sum("insertions").alias("insertions"))
