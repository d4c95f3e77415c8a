"""Vectors as the matrices that other tools take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.longform import explode_vectors


def coordinates(df: DataFrame) -> DataFrame:
    """(row_id, column, dim, val): a feature x sample matrix in coordinates, the columns
    numbered from 0 in the order of their dims."""
    long = explode_vectors(df.select("row_id", "vec"), keys=["row_id"])
    numbered = long.select("dim").distinct().select("dim", (F.row_number().over(W.orderBy("dim")) - 1).alias("column"))
    return long.join(numbered, "dim").select("row_id", "column", "dim", "val")


def ml_vectors(df: DataFrame, bits: int) -> DataFrame:
    """df with `features`, a pyspark.ml sparse vector of 2^bits (at most 2^31 - 1) places."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    if bits > 30:
        raise ValueError("pyspark.ml vectors have at most 2^31 - 1 places")
    size = 1 << bits
    make = F.udf(lambda v: SparseVector(size, [e["dim"] for e in v], [float(e["val"]) for e in v]), VectorUDT())
    return df.withColumn("features", make("vec"))
