"""Functions for SQL: hl_embed, hl_hash, hl_dot and hl_decode."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.hashing import hash_slices
from .functions.preprocess import decode_bytes
from .functions.vectors import VECTOR
from .operators.kernel import Kernel
from .session import ship_package


def register(spark: SparkSession, config: Config = Config()) -> list[str]:
    """Registers the functions for the session, hl_embed by the configuration (not for
    tfidf, which needs weights); gives their names."""
    if config.vect_embed == "tfidf":
        raise ValueError("hl_embed has no weights for tfidf")
    ship_package(spark)
    kernel = Kernel(config)

    def raw(s: pd.Series) -> list:
        return [None if x is None else x.encode() if isinstance(x, str) else bytes(x) for x in s]

    @F.pandas_udf(VECTOR)
    def hl_embed(s: pd.Series) -> pd.Series:
        return pd.Series(kernel.vectors(raw(s)).to_pylist())

    @F.pandas_udf("bigint")
    def hl_hash(s: pd.Series) -> pd.Series:
        data = raw(s)
        length = np.array([len(d or b"") for d in data], np.int64)
        h = hash_slices(np.frombuffer(b"".join(d or b"" for d in data), np.uint8), np.cumsum(length) - length, length, config.hash_algorithm)
        return pd.Series(h.view(np.int64)).where(pd.Series([d is not None for d in data]), None).astype("Int64")

    @F.pandas_udf("double")
    def hl_dot(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            known = {e["dim"]: np.float32(e["val"]) for e in y}
            return float(sum(float(np.float32(e["val"]) * known[e["dim"]]) for e in x if e["dim"] in known))

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    @F.pandas_udf("binary")
    def hl_decode(s: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else decode_bytes(d) for d in raw(s)])

    for f in (hl_embed, hl_hash, hl_dot, hl_decode):
        spark.udf.register(f.__name__, f)
    return ["hl_embed", "hl_hash", "hl_dot", "hl_decode"]
