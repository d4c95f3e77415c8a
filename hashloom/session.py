"""What this package needs of a Spark session: a shared folder, and its code on the executors."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_swept: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def drop_table(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def _sweep(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop_table(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which all executors
    share; it is emptied when the driver ends.  Where the setting is missing, a
    temporary folder is used in local mode (tests), and a cluster raises ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="hashloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/hashloom-{spark.sparkContext.applicationId}"
    if path not in _swept:
        _swept.add(path)
        atexit.register(_sweep, spark, path)
    return path


def written(df, tag: str):
    """df, written to the shared folder and read again; it is gone when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once an application, so that
    their Python workers can import it wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    archive = f"{shared_dir(spark)}/hashloom_source.zip"
    fs, where = _file_system(spark, archive)
    out = fs.create(where, True)
    out.write(raw.getvalue())
    out.close()
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
