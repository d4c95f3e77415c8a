"""Command line: python -m hashloom [options] INPUT OUTPUT."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import Config, ConfigError, load
from .plans.embedder import Embedder
from .sinks.codecs import load_weights, save_dictionary, save_weights
from .sinks.writers import with_features, write_vectors
from .sources.readers import read_source

#: option name -> flags beside --name
_FLAGS = {
    "input_format": "-i",
    "ngram_len": "-n",
    "granularity": "-g",
    "token_delim": "-d",
    "ngram_pos": "-p",
    "ngram_blend": "-B",
    "ngram_sort": "-s",
    "vect_embed": "-E",
    "vect_norm": "-N",
    "vect_sign": "-S",
    "hash_bits": "-b",
    "explicit_hash": "-X",
    "dim_reduce": "-r",
    "dim_num": "-m",
    "output_format": "-o",
    "skip_null": "-k",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hashloom", description="Embeds strings as sparse hashed vectors.")
    p.add_argument("-c", "--config_file", help="read options from this file first")
    p.add_argument("-v", "--verbose", action="count", default=0, help="say more")
    p.add_argument("-q", "--quiet", action="store_true", help="say errors only")
    p.add_argument("-C", "--print_config", action="store_true", help="print the options in force and end")
    p.add_argument("-D", "--print_defaults", action="store_true", help="print the default options and end")
    p.add_argument("-V", "--version", action="version", version=f"hashloom {__version__}")
    p.add_argument("--single_file", action="store_true", help="write one local file, in the order of the input")
    p.add_argument("--engine", choices=("arrow", "catalyst"), default="arrow")
    for f in dataclasses.fields(Config):
        flags = [*([_FLAGS[f.name]] if f.name in _FLAGS else []), f"--{f.name}"]
        if f.type == "bool":
            p.add_argument(*flags, dest=f.name, action="store_true", default=None)
        else:
            p.add_argument(*flags, dest=f.name, type={"int": int, "float": float, "str": str}[f.type], default=None)
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.ERROR if args.quiet else logging.WARNING - 10 * min(args.verbose, 2))
    given = {f.name: v for f in dataclasses.fields(Config) if (v := getattr(args, f.name)) is not None}
    try:
        config = load(args.config_file, **given) if args.config_file else Config(**given)
    except (ConfigError, OSError) as e:
        print(f"hashloom: {e}", file=sys.stderr)
        return 2
    if args.print_defaults or args.print_config:
        print((Config() if args.print_defaults else config).to_text(), end="")
        return 0
    if not args.input or not args.output:
        print("hashloom: needs an input and an output", file=sys.stderr)
        return 2
    own = spark is None
    spark = spark or SparkSession.builder.appName("hashloom").getOrCreate()
    try:
        run(spark, args.input, args.output, config, args.engine, args.single_file)
    finally:
        if own:
            spark.stop()
    return 0


def run(spark: SparkSession, source: str, target: str, config: Config, engine: str = "arrow", single_file: bool = False) -> None:
    """Reads, embeds and writes."""
    df = read_source(spark, source, config)
    embedder = Embedder(config, engine)
    if config.vect_embed == "tfidf":
        if os.path.exists(config.tfidf_file):
            embedder = Embedder(config, engine, idf=load_weights(spark, config.tfidf_file))
        else:
            embedder = embedder.fit(df)
            save_weights(config.tfidf_file, embedder.idf)
    out = embedder.transform(df)
    if config.explicit_hash or config.hash_file:
        entries = embedder.dictionary(df, chunked=config.explicit_hash)
        if config.explicit_hash:
            out = out.withColumn("chunk", F.floor(F.col("row_id") / config.chunk_size))
        if config.hash_file:
            save_dictionary(config.hash_file, entries)
        if config.dim_reduce == "none":
            out = with_features(out, entries)
    write_vectors(out, target, config, single_file)
